"""Exact top-k by inner product with M-trees, searched best first.

A vector x gets one more component, sqrt(m^2 - |x|^2) with m the largest norm,
and a query gets a 0 there; then the nearest points are those with the largest
inner products, and distances obey the triangle inequality.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a page; children of an inner node; rows of one tree; queries of one block.
#: Vectors in many dimensions are pruned little, so full pages matter more than small ones.
PAGE, FAN, TREE_ROWS, BLOCK = 512, 8, 4096, 4096


def usable(vector: Column) -> Column:
    """Not null, and every component is a finite number."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class Node:
    """A page: entries of a leaf or child nodes, each with its distance to this page's routing point.

    ``router`` is a row number, ``radius`` covers every point below; ``rows``
    are those of the entries or the children's routing points, ``vectors``
    theirs in one piece.
    """

    __slots__ = ("router", "radius", "rows", "vectors", "children", "distances", "radii")

    def __init__(self, router, radius, rows, vectors, children, distances):
        self.router, self.radius, self.rows, self.vectors = router, radius, rows, vectors
        self.children, self.distances = children, distances
        self.radii = np.array([c.radius for c in children or ()])


class MTree:
    """A tree over integer vectors (n x d) with ids; distances are computed in 64-bit floats."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.most = norms.max(initial=0.0)
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.most - norms, 0))[:, None]])
        # with large components inner products leave the whole numbers that floats hold
        self.exact = vectors if 4 * self.most < 2.0 ** 53 else vectors.astype(np.int64)
        self.root = self._build(np.arange(len(ids))) if len(ids) else None
        self.computed = 0

    def _from(self, row: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[row]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray) -> Node:
        middle = self.points[rows].mean(axis=0)
        router = rows[((self.points[rows] - middle) ** 2).sum(axis=1).argmin()]
        far = self._from(router, rows)
        if len(rows) <= PAGE:
            return Node(router, far.max(), rows, self.exact[rows], None, far)
        # farthest-first pivots, then every row goes to its nearest one
        pivots, near = [router], far.copy()
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < min(FAN, len(rows) // PAGE + 1) and near.max() > 0:
            pivots.append(rows[near.argmax()])
            gap = self._from(pivots[-1], rows)
            owner[gap < near] = len(pivots) - 1
            near = np.minimum(near, gap)
        parts = [rows[owner == i] for i in range(len(pivots))]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):  # equal or nearly equal points: halve them
            parts = np.array_split(rows, max(2, min(FAN, len(rows) // PAGE)))
        children = [self._build(p) for p in parts]
        heads = np.array([c.router for c in children])
        return Node(router, far.max(), heads, self.exact[heads], children, self._from(router, heads))

    def _scores(self, node: Node, fit: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.computed += len(fit)
        return (node.vectors if len(fit) == len(node.rows) else node.vectors[fit]) @ query

    def search(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) of all rows but ``own``; ties go to the smaller id."""
        if self.root is None:
            return []
        base = float((query.astype(np.float64) ** 2).sum()) + self.most
        query = query.astype(self.exact.dtype)
        slack = 1e-7 * (np.sqrt(base) + 1)  # rounding must never cut a row off

        def distance(score):
            return np.sqrt(np.maximum(base - 2.0 * np.asarray(score, np.float64), 0))

        best: list[tuple[int, int]] = []
        limit = np.inf
        start = float(distance(self.exact[self.root.router] @ query))
        queue = [(max(0.0, start - self.root.radius), 0, start, self.root)]
        serial = 1
        while queue:
            bound, _, to_router, node = heapq.heappop(queue)
            if bound > limit + slack:
                break
            # |d(q, router) - d(x, router)| bounds d(q, x) before it is computed
            known = np.abs(to_router - node.distances)
            if node.children is None:
                fit = np.flatnonzero(known <= limit + slack)
                if not len(fit):
                    continue
                scores, rows = self._scores(node, fit, query), node.rows[fit]
                if len(best) == k:
                    better = np.flatnonzero(scores >= best[-1][0])
                    if not len(better):
                        continue
                    scores, rows = scores[better], rows[better]
                ids = self.ids[rows]
                at = np.lexsort((ids, -scores))[:k + 1]
                found = [(int(scores[i]), int(ids[i])) for i in at if ids[i] != own]
                best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    limit = float(distance(best[-1][0]))
                continue
            fit = np.flatnonzero(known - node.radii <= limit + slack)
            if not len(fit):
                continue
            gaps = distance(self._scores(node, fit, query))
            for i, gap in zip(fit.tolist(), gaps.tolist(), strict=True):
                bound = max(0.0, gap - node.children[i].radius)
                if bound <= limit + slack:
                    heapq.heappush(queue, (bound, serial, gap, node.children[i]))
                    serial += 1
        return best


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The k rows with the largest integer inner product for each query row.

    ``vector`` holds whole numbers (array of long) whose scores fit in a long.
    Rows are dealt by hash to trees of about TREE_ROWS rows, queries to blocks
    of about BLOCK; every block meets every tree in one task, whose k best per
    query are merged.  So memory per task is bounded, and all rows count.

    Result: query_id, rank, vec_id, score; fewer than k ranks if there are
    fewer other rows.  Ties go to the smaller id.  Null ids or vectors and
    vectors with null components take no part.  An id that is repeated counts
    once (with its smallest vector).  Shorter vectors are read as padded with
    zeros.  An empty table gives no rows.  Other columns play no part.
    """
    flagged = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("vector"),
                             F.coalesce(is_query, F.lit(False)).alias("is_query"))
    flagged = flagged.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
                            & ~F.exists("vector", lambda x: x.isNull()))
    one = flagged.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.bool_or("is_query").alias("is_query"))
    sizes = flagged.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    trees, blocks = -(-sizes["n"] // TREE_ROWS) or 1, -(-sizes["q"] // BLOCK) or 1

    def dealt(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    base = one.select("vec_id", "vector", dealt("tree", trees).alias("tree"), every(blocks).alias("block"))
    asked = one.where("is_query").select("vec_id", "vector", dealt("block", blocks).alias("block"), every(trees).alias("tree"))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        width = max((len(v) for part in (rows, queries) for v in part["vector"]), default=0)
        tree = MTree(rows["vec_id"].to_numpy(), _matrix(rows["vector"], width))
        points = _matrix(queries["vector"], width)
        found = [(q, i, s) for q, point in zip(queries["vec_id"], points, strict=True) for s, i in tree.search(point, k, q)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = base.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_mtree_top5(spark, sf_dir) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    wide = table.where(usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return top_k(wide, F.col("vec_id") % 50 == 0)


SQL = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, min(v) AS v FROM u GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
