"""Connected components of links, whatever their number and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.llm.common import attach, fresh, parts

#: Links of one task at least; a short table is kept in few files, however many tasks a shuffle has.
LINKS = 2000


def _few(rows: DataFrame, links: int) -> DataFrame:
    return rows.coalesce(min(links // LINKS + 1, parts(rows)))


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """(u, v, m): m is the least node among u and its neighbours v in the n ``links``."""
    least = fresh(_few(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), n))
    return _few(attach(links, least, "u", "v", "n"), n)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Alternates large and small stars: each round links the neighbours of a
    node to the least of them, which halves long paths about every round.  A
    node with very many links is not gathered anywhere.  Nodes are compared
    as they are (strings or numbers); links with a null are ignored.  Each
    half round is kept in the shared folder, so lost executors cost one half
    round.  No links, no rounds.
    """
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    pairs = fresh(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not row["n"] or state == (row["n"], row["h"]):
            break
        state, n = (row["n"], row["h"]), row["n"]
        pairs = _few(pairs, n)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = fresh(_few(large.where("u <> v"), n))
        small = _with_least(large, n)
        pairs = fresh(_few(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), n))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
