import random

import numpy as np

from recordsearch.llm import quality

FOLDER = "/root/testdata/sf0.1"


def made(n=600):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(vocabulary, k=60)
        bad, toxic = i % 4 == 0, i % 6 == 1
        if bad:
            text = [w + "%%%" for w in text]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["nasty", "vile", "rotten"]))
        docs.append((i, " ".join(text), "en", "web" if bad else "press"))
        if i % 2 or i % 8 == 0 or i % 8 == 2:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_both_targets_are_learned(spark, rows):
    docs, labels = made()
    edges = [(9000, None, None, None), (9001, "", "en", "press"), (9002, "x" * 3_000_000, "en", "press"), (0, docs[0][1], "en", "web")]
    table = rows(docs + edges).selectExpr("*", "1 AS quality_score", "2 AS own")
    known = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table, known).collect()
    assert len(got) == len(docs) + len(edges)
    by = {r.doc_id: r for r in got}
    right = [by[i].accepted == (i % 4 != 0 and i % 6 != 1) for i in range(600)]
    assert np.mean(right) > 0.98
    assert all(0 <= r.quality_score <= 1 and 0 <= r.toxic_score <= 1 for r in got)
    assert len({(r.quality_score, r.toxic_score) for r in got if r.doc_id == 0}) == 1
    again = {r.doc_id: (r.quality_score, r.toxic_score) for r in quality.classify(table, known).collect()}
    assert again == {r.doc_id: (r.quality_score, r.toxic_score) for r in got}


def test_few_labels_and_no_rows(spark, rows):
    schema = "doc_id long, quality int, toxic int"
    table = rows([(1, "a b"), (2, None)])
    none = quality.classify(table, spark.createDataFrame([], schema))
    assert {(r.doc_id, r.quality_score, r.toxic_score, r.accepted) for r in none.collect()} == {(1, 1.0, 0.0, True), (2, 1.0, 0.0, True)}
    one = quality.classify(table, spark.createDataFrame([(1, 0, None)], schema))
    assert {(r.quality_score, r.accepted) for r in one.collect()} == {(0.0, False)}
    assert quality.classify(table.where("false"), spark.createDataFrame([(1, 0, 1)], schema)).collect() == []


def test_pseudo_labels_bring_words_that_no_label_has(spark, rows, monkeypatch):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = rng.choices(["plain", "words", "about", "something", "quiet"], k=20)
        if toxic:
            text[rng.randrange(20)] = "nasty" if i < 500 else "gruesome"
        docs.append((i, " ".join(text), "en", "forum" if toxic else "press"))
        if i < 500:
            labels.append((i, 1, int(toxic)))
    table = rows(docs)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    new, ordinary = [set(quality.text_features([w])[1].view(np.int64).tolist()) for w in ("gruesome", "ordinary")]
    new -= ordinary

    def weights():
        names, views, _ = quality.train(table, known)["toxic"]
        return {f: w for f, w in zip(names[0].tolist(), views[0].weights, strict=True) if f in new}

    assert len(weights()) == len(new) and min(weights().values()) > 0.5
    monkeypatch.setattr(quality, "ROUNDS", 0)
    assert not weights()


def test_own_columns_named_like_results(spark, rows):
    docs, labels = made(200)
    table = rows(docs).selectExpr("*", "'x' AS quality_score", "2 AS toxic_score", "3 AS accepted", "4 AS own")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.accepted_documents(table, known)
    assert kept.columns == table.columns
    got = kept.collect()
    assert {(r.quality_score, r.toxic_score, r.accepted, r.own) for r in got} == {("x", 2, 3, 4)}
    scored = quality.classify(table, known, tuple(table.columns))
    assert sorted(r.doc_id for r in scored.where("accepted").collect()) == sorted(r.doc_id for r in got)
    assert len(set(scored.columns)) == len(scored.columns)


def test_features_do_not_depend_on_neighbours():
    texts = ["Ab cd, cd %% x", "", "é È ab"]
    owner, value = quality.text_features(texts)
    for i, text in enumerate(texts):
        assert np.array_equal(value[owner == i], quality.text_features([text])[1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    row = scored.selectExpr("avg(int((quality_score >= 0.5) = (quality = 1))) AS quality",
                            "avg(int((toxic_score >= 0.5) = (toxic = 1))) AS toxic").first()
    assert row.quality > 0.97 and row.toxic > 0.97
