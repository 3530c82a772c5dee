import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from recordsearch.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def fold(level):
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
        levels.append(level)
    return levels


def way(levels, at):
    for level in levels[:-1]:
        begin = at // 2 * 2
        yield "".join(level[begin:at]), "".join(level[at + 1:begin + 2])
        at //= 2


def brute(items):
    """(doc_id, leaf, subroot, root, proof, folded root, verified), sorted, of (doc_id, source, lang, n_chars, text)."""
    langs, trees = {}, {}
    for i, source, lang, n, text in items:
        tampered = n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        leaves = [h(*map(said, (i, source, lang, m, text))) for m in (n, tampered)]
        langs.setdefault(lang, []).append((i is not None, i or 0, leaves[0], i, leaves[1]))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda x: x[:3])
        trees[lang] = fold([x[2] for x in langs[lang]])
    over = fold([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for at, (_, _, leaf, i, other) in enumerate(langs[lang]):
            path = [*way(trees[lang], at), *way(over, k)]
            node = other
            for before, after in path:
                node = h(before, node, after)
            out.append((i, leaf, trees[lang][-1][0], over[-1][0], h(*(b + a for b, a in path)), node, node == over[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, tmp_path, items, name):
    spark.createDataFrame(items, SCHEMA).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = merkle.op11_merkle_manifest(spark, str(tmp_path / name))
    return rows, sorted((tuple(r) for r in rows.collect()), key=repr)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    items = [(i, f"s{i % 3}", rng.choice(["en"] * 6 + ["de", "é", "z", None]), rng.choice([None, i]), rng.choice(["", "ü b", None, "x" * 50000]))
             for i in range(500)]
    items += [(7000, "s", "alone", 5, "a text"), (7001, None, "two", 1, "t"), (7002, None, "two", 1, "t"), (None, "s", "en", 4, "no id"),
              (None, "s", "en", 4, "no id"), (None, None, None, None, None), (3, "s", "en", 4, "id again"), (3, "s", "en", 4, "id again")]
    rows, got = run(spark, tmp_path, items, "many")
    assert got == brute(items)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert {r[-1] for r in got} == {True, False}
    for few in ([(1, "s", "en", 2, "t")], items[:2], items[:65]):
        assert run(spark, tmp_path, few, f"few{len(few)}")[1] == brute(few)
    assert run(spark, tmp_path, [], "none")[1] == []


def test_only_some_levels_are_kept(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'en' AS lang", "id AS pos", "'a' AS hash", "1 AS tree")
    found = merkle.manifest(docs, merkle.digest(merkle.field(F.col("doc_id"))))
    assert [level.count() for level in found.groups.levels] == [300, 5, 1]
    proofs = merkle.proofs(found).withColumn("again", merkle.folded(F.col("hash"), F.col("path")))
    assert proofs.where("again <> root OR size(path) <> 9").count() == 0  # 9 levels of nodes, no language beside
    wrong = proofs.withColumn("again", merkle.folded(merkle.digest(F.lit("x")), F.col("path")))
    assert wrong.where("again = root").count() == 0
