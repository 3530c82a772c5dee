import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordsearch.llm import decontaminate, mixing, pii
from recordsearch.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).checkpoint()
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before and (name == "pii") <= (after == before)
        before = after
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.find_questions(docs, bench).count() == 0
    assert pii.find_pii(docs).where("size(filter(pii, s -> s.base)) > 0").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.columns == [*columns, "taken"] and last.where("taken <= 0").count() == 0
    want = mixing.mix(docs).where("taken > 0").select("doc_id", "taken")
    assert sorted(map(tuple, last.select("doc_id", "taken").collect())) == sorted(map(tuple, want.collect()))


def test_every_source_gets_its_words(rows):
    items = [(i, "w " * (i % 50), "en", None if i % 9 == 0 else "s%d" % (i % 4)) for i in range(400)]
    items += [(400, None, "en", "s1"), (401, "", "en", "s9"), (3, items[3][1], "en", items[3][3]), (None, "a b", "en", "s1")]
    table = rows(items).selectExpr("*", "1 AS size", "2 AS kept", "3 AS src")
    got = mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.sum("size").alias("n"),
                                                  F.max("source_size").alias("s"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    rows_ = got.collect()
    assert all(r.t == int(r.target) and r.n == r.s and r.over <= 0 for r in rows_)
    assert abs(sum(r.target for r in rows_) - sum(r.n for r in rows_)) < 1
    assert mixing.mix(table.where("false")).collect() == []
    assert mixing.mixed(table).columns == [*table.columns, "taken"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    twin = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(twin.columns)
    columns = sorted(got.columns)
    want = twin.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    found = [tuple(r) for r in got.select(*columns).collect()]
    plain = lambda rows: sorted(repr([float(x) if isinstance(x, float | int) and not isinstance(x, bool) else x for x in r]) for r in rows)
    assert plain(found) == plain(want)


def test_numbers_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
