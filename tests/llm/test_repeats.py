import hashlib
import random
import re

from recordsearch.llm import repeats
from recordsearch.llm.queries import QUERIES


def brute(items, run=50):
    """By the definition, over all runs."""
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in items]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - run + 1):
                s = tuple(w[k:k + run])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - run + 1 if i is not None else 0):
            if first[tuple(w[k:k + run])] < i:
                gone[k:k + run] = [True] * run
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(50)] + ["é", " x", "日本", "😀"]

    def some(n):
        return rng.choices(vocabulary, k=n)

    passages = [some(n) for n in (49, 50, 51, 70, 120, 300)]
    items = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 45))
            parts += [some(rng.randrange(0, 40)), p[a:a + rng.randrange(45, 130)] if rng.random() < 0.5 else p]
        items.append((i * 3 % 61, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    copy = items[5][1]
    spam = "To " * 130
    return items + [(70 + i, copy) for i in range(5)] + [
        (90, spam), (91, spam * 3), (92, "x " + spam), (93, None), (94, ""), (None, copy), (None, None), (95, " ".join(some(20000))),
        (70, copy), (70, items[7][1]), (71, spam + copy)]


def test_equal_to_the_definition(spark, rows, tmp_path):
    for seed in (1, 2):
        items = corpus(seed)
        table = rows(items).selectExpr("*", "1 AS digest", "2 AS anchors", "3 AS home").repartition(3)
        table.write.parquet(f"{tmp_path}/{seed}/documents.parquet")
        got = QUERIES["op5_repeated_passages"](spark, f"{tmp_path}/{seed}").collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(items)


def test_many_small_shards(rows, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_CHARS", 500)
    monkeypatch.setattr(repeats, "TASK_DOCS", 7)
    items = corpus(3)[:60]
    got = repeats.repeated_passages(rows(items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(items)


def test_empty_table(rows):
    assert repeats.repeated_passages(rows([(1, "a")]).where("false")).collect() == []


def test_nothing_repeats(rows):
    got = repeats.repeated_passages(rows([(1, "a b"), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 2, 0), (2, 0, 0)]
