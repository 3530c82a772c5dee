"""Hard negatives by Strassen products of tiles and mergeable heaps.

Anchors and candidates meet in tiles.  The scores of a tile are one product of
two whole-number matrices, by Strassen's seven products of quarters.  A tile
keeps the few best positives of each of its anchors, later the few best
negatives of each positive's window; the best of all tiles are the best of all
rows, so these heaps are merged in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.llm.common import stored
from recordsearch.llm.mtree import usable

#: Candidates and anchors of a tile; the side below which a product is computed directly.
TILE, BLOCK, DIRECT = 4096, 1024, 48
#: Whole numbers below this are exact as 64-bit floats.
_FLOAT = 2.0 ** 53


def _most(x: np.ndarray) -> float:
    """A bound of the absolute values (as floats, so the least long can't overflow)."""
    return max(abs(float(x.min(initial=0))), abs(float(x.max(initial=0))))


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in whole numbers; by floats where every sum is sure to be exact."""
    if _most(a) * _most(b) * a.shape[1] < _FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for matrices of 64-bit whole numbers, with seven products of quarters for eight.

    Odd sides get a row or column of zeros.  Additions are exact modulo 2^64,
    so the result is right whenever it fits, even if a sum on the way doesn't.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= DIRECT:
        return _direct(a, b)
    if n % 2 or k % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
    if k % 2 or m % 2:
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    out = np.empty((2 * r, 2 * t), np.int64)
    c11, c12, c21, c22 = out[:r, :t], out[:r, t:], out[r:, :t], out[r:, t:]
    product = strassen(a11 + a22, b11 + b22)
    c11[:], c22[:] = product, product
    product = strassen(a21 + a22, b11)
    c21[:] = product
    c22 -= product
    product = strassen(a11, b12 - b22)
    c12[:] = product
    c22 += product
    product = strassen(a22, b21 - b11)
    c11 += product
    c21 += product
    product = strassen(a11 + a12, b22)
    c11 -= product
    c12 += product
    c22 += strassen(a21 - a11, b11 + b12)
    c11 += strassen(a12 - a22, b21 + b22)
    return out[:n, :m]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of every row; ties go to the smaller column."""
    if not allowed.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = scores.shape[1]
    if _most(scores) < 2.0 ** 61 / max(width, 1):  # score and column fit in one number, so a partition is enough
        one = np.where(allowed, scores * width + np.arange(width - 1, -1, -1), -np.iinfo(np.int64).max)
        top = np.argpartition(-one, k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), one.shape)
    else:
        order = np.lexsort((-scores, ~allowed), axis=1)  # stable, so columns stay in order
        top = order[:, :k]
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    column = top.ravel()
    kept = allowed[row, column]
    return row[kept], column[kept]


def window(positive: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest whole score that is at least ``least`` and at most ``most`` hundredths of each positive score."""
    # with the whole hundreds apart, so nothing overflows
    whole, rest = positive // 100, positive % 100
    return whole * least - (-(rest * least) // 100), whole * most + rest * most // 100


def _tiles(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], search, out: str) -> DataFrame:
    """What ``search`` gives for every block of anchors and tile of rows, each pair in one task's group."""
    tiles, blocks = (-(-n // size) or 1 for n, size in zip(sizes, (TILE, BLOCK), strict=True))

    def dealt(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    base = rows.select("vec_id", "label", "vector", dealt("tile", tiles).alias("tile"), every(blocks).alias("block"))
    own = [F.col(c).alias(c) for c in anchors.columns]  # not the same columns as those of the rows
    asked = anchors.select(*own, dealt("block", blocks).alias("block"), every(tiles).alias("tile"))
    return base.groupBy("tile", "block").cogroup(asked.groupBy("tile", "block")).applyInPandas(search, out)


def _scored(rows: pd.DataFrame, anchors: pd.DataFrame):
    """Rows by id, their scores with the anchors, and where the labels are equal."""
    rows = rows.sort_values("vec_id", ignore_index=True)
    width = max((len(v) for part in (rows, anchors) for v in part["vector"]), default=0)
    scores = strassen(_matrix(anchors["vector"], width), np.ascontiguousarray(_matrix(rows["vector"], width).T))
    return rows, scores, anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   vec_id: str = "vec_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels in the positive's window.

    The score is the integer inner product with the anchor; ties go to the
    smaller id.  An anchor's positives are its ``positives`` best other rows
    of its label; a negative's score is between ``least`` and ``most``
    hundredths of the positive's, so a negative positive score leaves no
    window.  Result: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score; fewer ranks where fewer rows fit.

    ``vector`` holds whole numbers (array of long) whose scores fit in a long.
    Every row counts for every anchor: all rows are dealt by the hash of their
    id to tiles of about TILE rows and meet every block of about BLOCK anchors,
    once for the positives and once, their scores known, for the windows.  So
    a task holds one tile's scores whatever the labels' sizes; hot labels and
    equal vectors change nothing.

    Null ids, labels or vectors and vectors with null components take no part.
    An id that is repeated counts once (with its smallest label and vector).
    Shorter vectors are read as padded with zeros.  An empty table gives no
    rows.  Other columns play no part.
    """
    flagged = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                             F.col(vector).cast("array<long>").alias("vector"),
                             F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).dropna(subset=["vec_id", "label", "vector"])
    flagged = flagged.where(~F.exists("vector", lambda x: x.isNull()))
    one = flagged.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v"), F.bool_or("is_anchor").alias("is_anchor"))
    one = stored(one.select("vec_id", "v.*", "is_anchor"))
    counted = one.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    sizes = (counted["n"], counted["a"])
    anchors = one.where("is_anchor").drop("is_anchor")

    def near(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows, scores, same = _scored(rows, asked)
        ids, own = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        row, column = best(scores, same & (own[:, None] != ids[None, :]), positives)
        return pd.DataFrame({"anchor_id": own[row], "positive_id": ids[column], "score": scores[row, column]}, dtype="int64")

    found = _tiles(one, anchors, sizes, near, "anchor_id long, positive_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    chosen = stored(found.groupBy("anchor_id").agg(  # ``positives`` an anchor
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("positives")))
    asked = anchors.join(chosen.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select(
        "vec_id", "label", "vector", "positives.positive_id", "positives.score")

    def within(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows, scores, same = _scored(rows, asked)
        ids, own = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        other, parts = ~same, []
        for place in range(max(map(len, asked["score"]), default=0)):
            has = np.flatnonzero([len(s) > place for s in asked["score"]])
            score = np.array([asked["score"].iloc[i][place] for i in has], np.int64)
            low, high = window(score, least, most)
            cut = scores[has]
            row, column = best(cut, other[has] & (cut >= low[:, None]) & (cut <= high[:, None]), negatives)
            named = np.array([asked["positive_id"].iloc[i][place] for i in has], np.int64)
            parts.append(pd.DataFrame({"anchor_id": own[has][row], "positive_id": named[row], "negative_id": ids[column],
                                       "positive_score": score[row], "negative_score": cut[row, column]}))
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pd.concat([pd.DataFrame(columns=names, dtype="int64"), *parts])[names].astype("int64")

    hard = _tiles(one, asked, sizes, within, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = table.where(usable(F.col("embedding"))).select(
        "vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return hard_negatives(whole, F.col("vec_id") % 50 == 0)


SQL = """
WITH u AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, min(label) AS label, arg_min(v, label) AS v FROM u GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
