import hashlib
import os

from recordsearch.llm import warc
from recordsearch.llm.common import new_folder

SCHEMA = "page_id long, url string, html string"


def brute(items):
    first = {}
    for number, _, html in items:
        raw = (html or "").encode()
        if len(raw) >= 100 and number is not None:
            first[raw] = min(first.get(raw, number), number)
    for number, url, html in items:
        raw = (html or "").encode()
        refers = first.get(raw, number)
        yield number, url, len(raw), hashlib.sha256(raw).hexdigest(), None if refers == number else refers


def write(spark, items, block=3):
    pages = spark.createDataFrame(items, SCHEMA).selectExpr("*", "1 AS key", "'x' AS digest", "2 AS n").repartition(3)
    archives, index = new_folder(spark, "warc"), new_folder(spark, "cdx")
    captures = warc.write_archives(pages, archives)
    shards = warc.write_index(captures, index, block)
    return captures, shards, archives, index


def items():
    long = "ä" * 60
    return [(i, f"http://h{i % 3}.example.org/p/{i % 7}?q={i % 2}", long if i % 4 == 0 else f"page {i} " * (i % 30)) for i in range(60)] + [
        (100, None, None), (101, "", ""), (102, "http://a.b/\r\nx%41", "<p>\r\n\r\n</p>" * 20), (103, "http://[bad", "x" * 99),
        (104, "http://[bad", "x" * 99), (None, "http://a.b/", "n" * 200), (105, "http://a.b/", "big " * 300000),
        (7, "http://h1.example.org/p/0?q=1", "page 7 " * 7), (106, "http://é.org/ü", "퟿")]


def test_every_record_comes_back(spark):
    captures, shards, archives, index = write(spark, items())
    got = warc.read_captures(captures, shards, archives, index).collect()
    rows = sorted(map(repr, ((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.refers_to) for r in got)))
    assert rows == sorted(map(repr, brute(items())))
    for r in got:
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert len(r.payload) == (r.payload_bytes if r.refers_to is None else 0)


def test_a_hot_address_over_many_blocks(spark):
    many = [(i, "http://one.org/", f"text {i} " * 20) for i in range(100)]
    captures, shards, archives, index = write(spark, many)
    key = warc.url_key("http://one.org/")
    look = warc.CaptureIndex([tuple(r) for r in shards.collect()], index)
    for i in (0, 1, 2, 3, 50, 98, 99):
        assert [x[1] for x in look.captures(key, i)] == [i]
    assert list(look.captures(key, 1000)) == [] and list(look.captures("zzz", 1)) == [] and list(look.captures("", 1)) == []


def test_members_are_plain_gzip(spark):
    _, _, archives, _ = write(spark, [(1, "http://a.org/", "x" * 300), (2, "http://a.org/2", "x" * 300)])
    import gzip
    folder = archives.removeprefix("file:").replace("//", "/")
    text = b"".join(gzip.open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.endswith(".gz"))
    assert text.count(b"WARC/1.1\r\n") == 2 and text.count(b"WARC-Type: revisit") == 1


def test_empty_table(spark):
    captures, shards, archives, index = write(spark, [])
    assert warc.read_captures(captures, shards, archives, index).collect() == []


def test_keys():
    assert warc.url_key("http://www.a.org/x?y=1#z") == "org,a,www)/x?y=1"
    assert warc.url_key(None) == warc.url_key("") == "-"
