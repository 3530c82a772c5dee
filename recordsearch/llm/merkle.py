"""Merkle manifests that keep only every few levels.

The rows of a group are the leaves of a tree, and the groups' roots are the
leaves of one more.  Between two stored levels lie aligned subtrees of a fixed
size: a proof regenerates the missing nodes of such a subtree from its stored
descendants, emits the siblings on the way up, and drops the nodes again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordsearch.llm.common import new_folder, parts, stored

#: Nodes below one parent; levels from one stored level to the next; proofs that leave a task together.
FAN, SPAN, BATCH = 2, 6, 2048

#: Siblings on the way up: at each level the digests before and after the node, joined.
PATH = "array<struct<before:string,after:string>>"


def digest(*values: Column) -> Column:
    """H: lowercase hex SHA-256 of the values, concatenated."""
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    """A value so that its end is known: `-` for null, else its UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _above(level: list[str]) -> list[str]:
    return [sha256("".join(level[i:i + FAN]).encode()).hexdigest() for i in range(0, len(level), FAN)]


def _climbed(n: int) -> tuple[int, int]:
    """Levels from n nodes up to the next stored level or the root, and the nodes there."""
    levels = 0
    while n > 1 and levels < SPAN:
        n, levels = -(-n // FAN), levels + 1
    return levels, n


def regenerated(members: list[str], levels: int) -> list[list[str]]:
    """The nodes of an aligned subtree, level by level from its stored descendants."""
    found = [members]
    for _ in range(levels):
        found.append(_above(found[-1]))
    return found


def siblings(subtree: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """(before, after) of the node at place ``at`` of the lowest level and of its ancestors below the top."""
    for level in subtree[:-1]:
        begin = at // FAN * FAN
        yield "".join(level[begin:at]), "".join(level[at + 1:begin + FAN])
        at //= FAN


@dataclass
class Trees:
    """Stored levels of one tree a group: rows (tree, pos, hash, n), SPAN levels apart, the last with one row a tree.

    ``n`` is the number of nodes of the tree at that level.  The first level
    also has the columns ``kept``.
    """

    levels: list[DataFrame]
    kept: tuple[str, ...]


def placed(rows: DataFrame, folder: str, tree: str, order: list[str]) -> DataFrame:
    """Rows with pos, their place within the tree, and n, the rows of the tree; stored in ``folder``.

    Rows are cut into ranges by tree and order and stored once, so a tree of
    any size is spread over tasks and a repeated task numbers the same rows;
    the last of the range columns parts equal rows.
    """
    spread = F.rand(11)
    cut = rows.withColumn("_spread", spread).repartitionByRange(parts(rows), tree, *order, "_spread").drop("_spread")
    cut = stored(cut.withColumn("_slice", F.spark_partition_id()), f"{folder}/cut")
    sizes = cut.groupBy(tree, "_slice").agg(F.count("*").alias("_rows"))  # a row a tree, and one for each border in it
    within = Window.partitionBy(tree)
    before = within.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(tree, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
                           F.sum("_rows").over(within).alias("n"))
    own = Window.partitionBy(tree, "_slice").orderBy(*order)
    numbered = cut.withColumn("_place", F.row_number().over(own) - 1).join(offsets, [tree, "_slice"])
    return stored(numbered.withColumn("pos", F.col("_place") + F.col("_offset")).drop("_place", "_offset", "_slice"),
                  f"{folder}/level0")


def _subtrees(level: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row for each aligned subtree: its stored descendants in order, FAN^SPAN at most."""
    member = F.struct("pos", "hash", *kept)
    return level.groupBy("tree", F.floor(F.col("pos") / FAN ** SPAN).cast("long").alias("block")).agg(
        F.any_value("n").alias("n"), F.sort_array(F.collect_list(member)).alias("members"))


def _fold(batches):
    for batch in batches:
        rows = zip(batch.column("n").to_pylist(), batch.column("hashes").to_pylist(), strict=True)
        tops = [(regenerated(hashes, _climbed(n)[0])[-1][0], _climbed(n)[1]) for n, hashes in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), pa.array([t[0] for t in tops], pa.string()),
             pa.array([t[1] for t in tops], pa.int64())], names=["tree", "pos", "hash", "n"])


def grow(leaves: DataFrame, folder: str, kept: tuple[str, ...] = ()) -> Trees:
    """All stored levels above the leaves (tree, pos, hash, n and the columns ``kept``)."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        blocks = _subtrees(levels[-1]).select("tree", "block", "n", F.col("members.hash").alias("hashes"))
        levels.append(stored(blocks.mapInArrow(_fold, "tree string, pos long, hash string, n long"),
                             f"{folder}/level{SPAN * len(levels)}"))
    return Trees(levels, kept)


def _extract(kept: StructType):
    """The proofs of a subtree's members: their siblings in it, then the path of the subtree's top."""
    def extract(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column("members")[row].values
                hashes = members.field("hash").to_pylist()
                levels, _ = _climbed(batch.column("n")[row].as_py())
                subtree = regenerated(hashes, levels)
                upper = batch.column("path")[row].as_py()
                over = [(s["before"], s["after"]) for s in upper]
                steps = [[*siblings(subtree, i), *over] for i in range(len(hashes))]
                offsets = np.cumsum([0, *map(len, steps)]).astype(np.int32)
                flat = [s for path in steps for s in path]
                path = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], ["before", "after"]))
                same = [pa.array([batch.column(c)[row].as_py()] * len(hashes), pa.string()) for c in ("tree", "top", "root")]
                yield pa.RecordBatch.from_arrays(
                    [same[0], members.field("pos"), members.field("hash"), path, *same[1:], *(members.field(c) for c in kept.names)],
                    names=["tree", "pos", "hash", "path", "top", "root", *kept.names])

    return extract


def extracted(trees: Trees, tops: DataFrame) -> DataFrame:
    """(tree, pos, hash, path, top, root and ``kept``) of every leaf, from the stored levels, top down.

    ``tops`` says for each tree what lies above it: (tree, path, top, root).
    Only paths of stored nodes meet their subtrees by key, and each key is one
    subtree, so nothing is hot.
    """
    paths = trees.levels[-1].join(tops, "tree").select("tree", "pos", "path", "top", "root")
    if len(trees.levels) == 1:
        return trees.levels[0].join(tops, "tree").select("tree", "pos", "hash", "path", "top", "root", *trees.kept)
    for number in range(len(trees.levels) - 2, -1, -1):
        kept = () if number else trees.kept
        level = trees.levels[number]
        blocks = _subtrees(level, kept).join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])
        types = StructType([level.schema[c] for c in kept])
        schema = f"tree string, pos long, hash string, path {PATH}, top string, root string"
        out = StructType([*StructType.fromDDL(schema), *types])
        paths = blocks.mapInArrow(_extract(types), out)
    return paths


@dataclass
class Manifest:
    """A dataset's manifest: stored levels of the groups' trees and of the tree over their roots."""

    groups: Trees
    over: Trees
    folder: str


def manifest(docs: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id",
             keep: dict[str, Column] | None = None) -> Manifest:
    """Stored manifest of all rows: of each group the tree over its leaves by ``order``, and one tree over the groups.

    While several nodes remain, each run of FAN consecutive ones becomes its
    H; the last run may have fewer, even one.  Groups are in the order of
    their UTF-8 bytes, null first.  Null ids come first; rows with equal ids
    are in the order of their leaves, so repeated rows can't change a root.
    Texts of any length are read once, by the expression ``leaf``; behind it
    only digests and the columns ``keep`` (narrow ones) are shuffled.  No
    rows, no root.  Column names of ``docs`` clash with nothing.
    """
    spark, keep = docs.sparkSession, keep or {}
    folder = new_folder(spark, "manifest")
    tree = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))  # "-" is before ":"
    rows = docs.select(tree.alias("tree"), F.col(order).alias("_id"), leaf.alias("hash"), *[c.alias(n) for n, c in keep.items()])
    leaves = placed(rows, f"{folder}/groups", "tree", ["_id", "hash"]).drop("_id")
    groups = grow(leaves, f"{folder}/groups", tuple(keep))
    roots = groups.levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    over = grow(placed(roots, f"{folder}/over", "tree", ["name"]), f"{folder}/over", ("name",))
    return Manifest(groups, over, folder)


def proofs(found: Manifest) -> DataFrame:
    """(tree, pos, hash, path, top, root and kept columns) of every row: ``top`` is its group's root, ``path`` leads to ``root``."""
    nothing = F.array().cast(PATH)
    root = found.over.levels[-1].select("tree", nothing.alias("path"), F.col("hash").alias("top"), F.col("hash").alias("root"))
    above = extracted(found.over, root).select(F.col("name").alias("tree"), "path", F.col("hash").alias("top"), "root")
    return extracted(found.groups, above)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def path_digest(path: Column) -> Column:
    """H of all siblings of a path, from the leaf up."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def op11_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = ["doc_id", "source", "lang", "n_chars", "text"]

    def leaf(n_chars: Column) -> Column:
        return digest(*[field(n_chars if c == "n_chars" else F.col(c)) for c in plain])

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(F.col("n_chars") + 1))
    found = manifest(docs.select(*plain), leaf(F.col("n_chars")), keep={"doc_id": F.col("doc_id"), "tampered": tampered})
    rows = proofs(found)
    again = folded(F.coalesce("tampered", "hash"), F.col("path"))
    return rows.select("doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root",
                       path_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of the decimal id, bit by bit over its characters; levels by recursion.
SQL = """
WITH RECURSIVE crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
      CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS v
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
rows_ AS (SELECT d.*, n_chars + CASE WHEN v % 7 = 0 THEN 1 ELSE 0 END AS m FROM documents d LEFT JOIN crc USING (doc_id)),
said AS (SELECT doc_id, lang, n_chars, m,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM rows_),
leaves AS (SELECT doc_id, lang, sha256(a || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(length(CAST(m AS VARCHAR)) || ':' || m, '-') || z) AS other FROM said),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT 0 AS level, lang, pos, leaf AS hash, n FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 1) // 2) FROM nodes
    WHERE n > 1 GROUP BY level, lang, pos // 2),
subroots AS (SELECT lang, hash, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
    count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tops
    WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT hash AS root FROM tops WHERE n = 1),
ways AS (SELECT p.doc_id, p.leaf, p.other, s.hash AS subroot, s.height, s.pos AS place, p.lang, p.pos,
    unnest(range(s.height + (SELECT max(level) FROM tops))) AS step FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
asked AS (SELECT *, CASE WHEN step < height THEN pos // (1 << step) ELSE place // (1 << (step - height)) END AS at FROM ways),
steps AS (SELECT a.*, CASE WHEN a.at % 2 = 1 THEN coalesce(x.hash, y.hash) ELSE '' END AS before,
    CASE WHEN a.at % 2 = 0 THEN coalesce(x.hash, y.hash, '') ELSE '' END AS after FROM asked a
  LEFT JOIN nodes x ON a.step < a.height AND x.level = a.step AND x.lang IS NOT DISTINCT FROM a.lang AND x.pos = xor(a.at, 1)
  LEFT JOIN tops y ON a.step >= a.height AND y.level = a.step - a.height AND y.pos = xor(a.at, 1)),
paths AS (SELECT lang, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof,
    list([before, after] ORDER BY step) AS path FROM steps GROUP BY lang, pos),
final AS (SELECT p.doc_id, p.leaf, s.hash AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend([p.other, ''], coalesce(path, [])), lambda x, y: [sha256(y[1] || x[1] || y[2]), ''])[1] AS folded_root
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
  LEFT JOIN paths w ON p.lang IS NOT DISTINCT FROM w.lang AND p.pos = w.pos)
SELECT *, folded_root = root AS verified FROM final
"""
