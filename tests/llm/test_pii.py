import hashlib
import random
import re

import pytest

from recordsearch.llm import pii
from recordsearch.llm.queries import QUERIES

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, kind in enumerate(RULES)
             for m in re.finditer(RULES[kind], text or "") if valid(kind, m[0])]
    listed = ",".join(f"{kind}:{s}:{e}" for s, k, kind, e in sorted(spans))
    return [sum(x[2] == k for x in spans) for k in RULES], hashlib.sha256(listed.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    pieces = ["a@b.co", "x_y.z@mail-1.example.com", "a@b.c@d.e", "a@b.c_x@d.e", "@", "é", "😀", "\n", "1.2.3.4", "1.2.3.4.5.6.7.8",
              "300.1.1.1", "001.2.3.4", "4465758382889437", "4465758382889437 4465758382889437", "4465-7583-8288-9437",
              "+1 (743) 555-3824", "+49 30 1234567", "+1", "12", " ", ".", "-", "+", "word", "DE89370400440532013000",
              "DE89 3704 0044 0532 0130 01", "call 212 555 1234", "order 4465758382889437"]
    made = ["".join(rng.choice(pieces) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    return made + [None, "", "9" * 30000, "a" * 60000, "1.1.1.1 " * 4000, "+1 234 567 8901 " * 1500, "a@b.c" * 5000]


def test_base_spans_equal_the_rules(spark, rows, tmp_path):
    items = list(enumerate(texts()))
    rows(items).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(items)
    for i, text in items:
        counts, digest = brute(text)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts, text
        assert got[i].base_sha256 == digest, text


def test_method_adds_checked_spans(rows):
    found = {r.doc_id: r.pii for r in pii.find_pii(rows([
        (1, "4465758382889437 4465758382889437"), (2, "iban DE89 3704 0044 0532 0130 00 ok"),
        (3, "iban DE89 3704 0044 0532 0130 01 ok"), (4, "call 212 555 1234 now"), (5, "item 212 555 1234 now")])).collect()}
    assert [(s.start, s.end, s.base) for s in found[1]] == [(0, 16, False), (17, 33, False)]
    assert [(pii.KINDS[s.kind], s.start) for s in found[2]] == [("iban", 5)]
    assert found[3] == [] and found[5] == []
    assert [pii.KINDS[s.kind] for s in found[4]] == ["phone"]


def test_masking(rows):
    masked = {r.doc_id: r.text for r in pii.mask_pii(rows([
        (1, "é a@b.co and 1.2.3.4"), (2, None), (3, ""), (4, "plain"), (5, "1.2.3.4"), (5, "1.2.3.4")])).collect()}
    assert masked == {1: "é [EMAIL] and [IP]", 2: None, 3: "", 4: "plain", 5: "[IP]"}


def test_empty_table_and_clashing_names(spark, rows):
    assert pii.find_pii(rows([(1, "x")]).where("false")).collect() == []
    clash = rows([(1, "a@b.co")]).selectExpr("*", "'p' AS pii", "1 AS start", "2 AS kind")
    assert [len(r.pii) for r in pii.find_pii(clash).collect()] == [1]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    row = spark.range(1).selectExpr(f"transform(slice(sequence(0, {n}), 1, {n}), x -> cast(x % 7 AS int)) AS a")
    got = row.select(pii.running_sums(row.a).alias("s")).first().s
    want = [sum(i % 7 for i in range(j)) for j in range(n)]
    assert got == want
