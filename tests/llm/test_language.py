import random
import zlib

import numpy as np
import pytest

from recordsearch.llm import language
from recordsearch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def docs():
    rng = random.Random(3)
    made = [(i, words(rng, "abcdeé" if i % 2 else "xyzuvß", 30), "aa" if i % 2 else "xx") for i in range(200)]
    return made + [(900, None, "aa"), (901, "", "xx"), (902, "123 !?", "xx"), (903, "abcde", None), (904, "ABC ÉED abc", "xx"),
                   (905, "xyz " * 400000, None), (3, made[3][1], "aa")]


def test_edge_texts_and_held_out_rows(spark, rows, tmp_path):
    items = docs()
    rows(items).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(items)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904, 905)] == ["und", "und", "und", "aa", "aa", "xx"]
    assert all(0 <= r.score <= 1 for r in got)
    right = [by[i].lang_pred == lang for i, _, lang, *_ in items[:200]]
    assert np.mean(right) > 0.99


def test_scores_equal_a_plain_sum():
    texts = ["Abc, dé", "x", "", "a b"]
    found, sizes = language.features(texts)
    each = [language.features([t])[0] for t in texts]
    assert sizes.tolist() == [len(e) for e in each]
    assert np.array_equal(np.sort(found[:sizes[0]]), np.sort(each[0]))
    assert np.array_equal(each[1], language.features(["X"])[0])


def test_nothing_to_learn_and_no_rows(spark, rows):
    table = rows([(1, "abc", None), (2, None, None)]).selectExpr("*", "'c' AS score", "'d' AS lang_pred")
    model = language.learn(table, table.doc_id < 0)
    assert model is None
    assert {(r.doc_id, r.lang_pred, r.score) for r in language.predict(table, model).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language.predict(table.where("false"), model).collect() == []


def test_held_out_accuracy(spark):
    pytest.importorskip("pyarrow")
    got = QUERIES["op4_language_id"](spark, FOLDER)
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    row = got.where("held_out").join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS right").first()
    assert row.right > 0.97
