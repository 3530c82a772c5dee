"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from testbed import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, str):
        return value
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def lines(columns, rows):
    return columns, sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = found.select(*[f"`{c}`" for c in columns]).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    twin = duck.sql(sql)
    names = sorted(twin.columns)
    quoted = ", ".join(f'"{c}"' for c in names)
    assert lines(columns, rows) == lines(names, twin.project(quoted).fetchall())


def test_only_excerpt_layouts_and_stems_lack_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"highlight_merged", "stem_vocabulary", "search_portuguese"}


def test_stems_and_search_equal_a_plain_reading(spark, duck):
    """The queries without SQL, over whole tables, against words stemmed and counted one by one."""
    from math import log

    import regex

    from recordsearch.functions.portuguese import stem_text
    from recordsearch.functions.text import portuguese_analysis

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    exact = {i: regex.findall(r"[\p{L}\p{N}]+", x.lower()) for i, x in texts.items()}
    language = portuguese_analysis()
    words = {w for found in exact.values() for w in found}
    stems = {w: stem_text(w) for w in words}
    got = entry.queries()["stem_vocabulary"](spark, FOLDER).collect()
    assert {(r.token, r.norm) for r in got} == set(stems.items()) and len(got) == len(stems)
    plain = {i: [stems[w] for w in found if w not in language.stopwords] for i, found in exact.items()}
    n, mean, exact_mean = len(plain), sum(map(len, plain.values())) / len(plain), sum(map(len, exact.values())) / len(exact)

    def idf(df):
        return log(1 + (n - df + 0.5) / (df + 0.5))

    def bm25(tf, weight, length, average):
        return weight * tf / (tf + 1.2 * (0.25 + 0.75 * length / average)) if tf else 0.0

    def doc_freq(side, w):
        return sum(w in found for found in side.values())

    one = language.words("ciones")[0]
    assert language.words("los") == ["los"]
    want = {}
    for i in plain:
        pairs = sum(exact[i][k:k + 2] == ["de", "la"] for k in range(len(exact[i])))
        tf, los, begun = plain[i].count(one), plain[i].count("los"), any(w.startswith("mente") for w in plain[i])
        first = bm25(tf, idf(doc_freq(plain, one)), len(plain[i]), mean)
        second = (bm25(los, idf(doc_freq(plain, "los")), len(plain[i]), mean)
                  + bm25(pairs, idf(doc_freq(exact, "de")) + idf(doc_freq(exact, "la")), len(exact[i]), exact_mean))
        if tf and (los or pairs) and not begun:
            want[i] = round(first + second + 1, 6)
    found = {r.id: r.score for r in entry.queries()["search_portuguese"](spark, FOLDER).collect()}
    assert sorted(found.values()) == pytest.approx(sorted(sorted(want.values(), reverse=True)[:50]), abs=2e-6)
