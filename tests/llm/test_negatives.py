import random

import numpy as np

from recordsearch.llm import negatives


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for n, k, m in ((1, 1, 1), (0, 3, 5), (200, 64, 333), (301, 129, 77), (97, 97, 97)):
        for big in (100, 1 << 40, 1 << 62):
            a, b = rng.integers(-big, big, (n, k)), rng.integers(-big, big, (k, m))
            assert (negatives.strassen(a, b) == a @ b).all()


def test_best_breaks_ties_by_place():
    scores = np.array([[3, 9, 9, 9, 1], [2, 2, 2, 2, 2]])
    for factor in (1, 1 << 59):
        row, column = negatives.best(scores * factor, np.array([[True] * 5, [False, True, False, True, True]]), 2)
        assert sorted(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 3)]
        assert len(negatives.best(scores * factor, np.zeros((2, 5), bool), 2)[0]) == 0


def test_window_bounds():
    for p in [*range(-250, 250), 9 * 10 ** 18, -9 * 10 ** 18]:
        low, high = negatives.window(np.array([p]), 50, 95)
        assert (low[0], high[0]) == (-(-50 * p // 100), 95 * p // 100)


def brute(items):
    rows = {}
    for i, label, v in items:
        if i is not None and label is not None and v is not None and None not in v:
            rows[i] = min(rows.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in rows.items() if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(a, p, rank, s[1], -score, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out)


def test_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, rng.choice([1, 1, 1, 2, 3, None]), [rng.randrange(-9, 30) for _ in range(6)]) for i in range(400)]
    items += [(i, 1, [5, 5, 5]) for i in range(400, 520)] + [(i, 2, [4, 5, 4]) for i in range(520, 600)]
    items += [(50, 1, [1, 2, 3]), (50, 1, [0, 9, 9, 9, 9, 9]), (None, 1, [1]), (601, 1, None), (602, 1, [1, None]), (650, 77, [1] * 6), (700, 1, [])]
    table = spark.createDataFrame(items, "vec_id long, label int, vector array<long>").selectExpr("*", "1 AS tile", "2 AS block", "3 AS score")
    want = brute(items)
    assert want
    for tile, block in ((4096, 1024), (100, 4)):
        monkeypatch.setattr(negatives, "TILE", tile)
        monkeypatch.setattr(negatives, "BLOCK", block)
        got = negatives.hard_negatives(table, table.vec_id % 50 == 0)
        assert sorted(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(table.where("false"), table.vec_id % 50 == 0).collect() == []
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
