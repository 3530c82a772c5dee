import numpy as np
import pytest

from recordsearch.llm import mtree
from recordsearch.llm.queries import QUERIES


def brute(ids, vectors, query, own, k):
    scores = vectors.astype(np.int64) @ query.astype(np.int64)
    order = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != own)
    return [(-s, i) for s, i in order[:k]]


@pytest.mark.parametrize("kind", ["clustered", "uniform", "equal", "few", "large"])
def test_trees_equal_brute_force(kind):
    rng = np.random.default_rng(4)
    n = {"few": 3, "equal": 700}.get(kind, 3000)
    if kind == "clustered":
        vectors = rng.integers(-200, 200, (20, 8))[rng.integers(0, 20, n)] + rng.integers(-3, 4, (n, 8))
    elif kind == "equal":
        vectors = np.full((n, 8), 7)
    else:
        vectors = rng.integers(-256, 256, (n, 8)) * (10 ** 6 if kind == "large" else 1)
    ids = rng.permutation(n * 3)[:n]
    tree = mtree.MTree(ids, vectors.astype(float))
    for at in range(0, n, 97):
        assert tree.search(vectors[at].astype(float), 5, ids[at]) == brute(ids, vectors, vectors[at], ids[at], 5)
    if kind == "clustered":  # bounds save most of the work
        assert tree.computed < 0.7 * n * len(range(0, n, 97))


def test_edges(spark, tmp_path):
    items = [(i, [float(i % 7) / 10, -0.3, 0.5]) for i in range(120)] + [
        (200, None), (250, [None, 1.0, 1.0]), (300, [float("nan"), 1.0, 1.0]), (350, [float("inf"), 0.0, 0.0]), (400, []),
        (450, [0.5]), (0, [0.0, -0.3, 0.5])]
    table = spark.createDataFrame(items, "vec_id long, embedding array<float>").selectExpr("*", "3 AS rank", "4 AS score")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["op3_mtree_top5"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    valid = {i: np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 3 - len(v))))
             for i, v in items if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    ids, vectors = np.array(list(valid)), np.stack(list(valid.values()))
    assert sorted(got) == [0, 50, 100, 400, 450]
    for q, found in got.items():
        assert [x[1:] for x in sorted(found)] == brute(ids, vectors, valid[q], q, 5)
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, vector array<long>"), mtree.F.lit(True)).collect() == []
