import random
from collections import Counter

import numpy as np
import pytest

from recordsearch.llm import neardup, words
from recordsearch.llm.graph import components


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain(text):
    w = (text or "").split()
    if not w:
        return []
    k = min(5, len(w))
    seen, out = Counter(), []
    for i in range(len(w) - k + 1):
        s = tuple(w[i:i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(items):
    """Classes by all pairs of different texts."""
    texts = sorted({tuple((t or "").split()) for _, t in items} - {()})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = plain(" ".join(a)), plain(" ".join(b))
            m = lcs(x, y)
            if m and m / (len(x) + len(y) - m) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for i, t in items:
        key = tuple((t or "").split())
        if key and i is not None:
            least[root(key)] = min(least.get(root(key), i), i)
    return sorted(((i, least.get(root(tuple(t.split()))) if (t or "").split() else i) for i, t in items), key=repr)


def corpus(seed=1, n=14):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    items = []
    for g in range(n):
        base = rng.choices(vocabulary, k=rng.choice([4, 30, 90, 200]))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], ["x%d" % rng.randrange(99)], [copy[at], "y"]])
            items.append((len(items), " ".join(copy)))
    passage = " ".join(rng.choices(vocabulary, k=60))
    items += [(len(items) + i, passage + " " + " ".join(rng.choices(vocabulary, k=50))) for i in range(6)]
    end = len(items)
    return items + [(end, None), (end + 1, ""), (end + 2, " \n"), (end + 3, "a  b"), (end + 4, "a\nb"), (0, items[0][1]),
                    (None, items[3][1]), (None, "only null ids here"), (end + 5, "z " * 200000), (end + 6, "z " * 200001)]


def test_classes_equal_all_pairs(rows):
    items = corpus(1)
    table = rows(items).selectExpr("*", "1 AS node", "2 AS digest", "3 AS class_id", "4 AS key").repartition(3)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(table).collect()), key=repr)
    small = [x for x in items if len(x[1] or "") < 100000]
    want = brute_classes(small)
    last = [x[0] for x in items if len(x[1] or "") > 100000]
    assert got == sorted(want + [(i, last[0]) for i in last], key=repr)


@pytest.mark.parametrize("common", [0.8, 0.85])
def test_pairs_on_one_template_are_all_found(rows, common):
    rng = random.Random(7)
    size, items, want = 200, [], {}
    template = ["t%d" % i for i in range(int(size * common))]
    for i in range(300):
        own = ["u%d_%d" % (i, j) for j in range(size - len(template))]
        other = own[:len(own) * 7 // 10] + ["v%d_%d" % (i, j) for j in range(len(own) - len(own) * 7 // 10)]
        for body in (own, other):
            items.append((len(items), " ".join(template + body)))
            want[len(items) - 1] = 2 * i
    rng.shuffle(items)
    few = items[:12]
    assert brute_classes(few) == sorted(((i, min(j for j, _ in few if want[j] == want[i])) for i, _ in few), key=repr)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(rows(items)).collect()}
    assert got == want


def test_one_of_each_class_stays(rows):
    items = corpus(3, 6)
    table = rows(items).selectExpr("*", "1 AS root")
    kept = neardup.without_near_duplicates(table)
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    classes = brute_classes([x for x in items if len(x[1] or "") < 100000])
    long = min(x[0] for x in items if len(x[1] or "") > 100000)
    want = {c for i, c in classes if c is not None} | {long}
    assert ids == sorted([*want, None], key=repr) and kept.columns == table.columns
    empty = rows([(1, "a")]).where("false")
    assert neardup.near_duplicates(empty).collect() == [] and neardup.without_near_duplicates(empty).collect() == []


def test_alignment_and_sketches():
    rng = np.random.default_rng(1)
    one = words.shingles(rng.integers(0, 1 << 40, 300).astype(np.uint64), 5)
    assert neardup.similarity(one, one) == 1.0
    assert neardup.similarity(one, one[:220]) == 0.0
    assert abs(neardup.similarity(one, np.delete(one, slice(100, 130))) - 266 / 296) < 1e-9
    moved = np.concatenate([one[150:], one[:150]])  # the same set in another order
    assert neardup.similarity(one, moved) == 0.0
    wide = rng.integers(0, 1 << 60, 200_000).astype(np.uint64)
    assert len(neardup.sketches(wide)) == neardup.SKETCHES
    assert (neardup.sketches(one) == neardup.sketches(one.copy())).all()


def test_estimates_do_not_grow_with_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    sizes = []
    for _ in range(2):
        found = components(links)
        sizes.append(len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        links = found.select(found.node.alias("a"), found.root.alias("b"))
    assert max(sizes) < 100  # digits
    assert {r.root for r in found.collect()} == {0}
    assert components(links.where("false")).collect() == []


def test_components(spark):
    links = [(5, 5), *[(i, i + 1) for i in range(100, 140)], *[(200, i) for i in range(201, 260)], (9, 3), (3, 7), (20, 21), (21, 22),
             (22, 20), (30, 4), (4, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for pair in links for x in pair if pair[0] != pair[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
