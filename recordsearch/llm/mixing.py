"""Mix sources to target weights (native: built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.llm.common import checkpointed, word_count

#: Hash ranges per source are 16 to this power; they bound a task, not the result.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1),
                   most: int = 3) -> DataFrame:
    """Target of each source from (src, source_size), one row per source.

    Sources in order of ``src`` take the weights in turn and share the sum of
    all sizes.  No target exceeds ``most`` times the source's size; what is
    cut off goes to the others by weight.  With the sources ordered by cap per
    weight, the common level is the largest of what the sources from each one
    on could share, so one pass replaces the rounds of resharing.
    """
    by_name = Window.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = F.coalesce(
        F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    all_rows = Window.partitionBy(F.lit(1))
    return (
        ranked.withColumn("level", (F.sum("source_size").over(all_rows) - before) / rest)
        .withColumn("level", F.max("level").over(all_rows))
        .select("src", "source_size",
                F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words that the mix takes of each document.

    Each document gets a hash-random key (md5 of its id).  Within a source the
    documents are sorted by key over ranges of the hash space; prefix sums of
    sizes run over the ranges first and inside each range next, and are cut at
    the source's budget, the whole part of its target.  Whole epochs are taken
    of every document, the last, partial one up to the cut; the document at
    the cut is taken in part, so a source's words equal its budget.

    Result: doc_id, source, size, source_size, target, taken, a row per row;
    with ``keep``, a struct ``kept`` of these columns, too, which are shuffled
    once and never stored.
    Null text has size 0; null source is a source of its own, after all others;
    null ids share one key.  Repeated rows are documents of their own (equal
    key, ordered by size).  An empty table gives an empty result.  Columns
    other than the three named play no part.
    """
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))

    def keyed(*more):
        return docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            F.when(F.col(source).isNull(), F.lit("t"))  # after every "s..."
            .otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("src"),
            word_count(F.col(text)).alias("size"), key.alias("key"), *more)

    rows = checkpointed(keyed())
    whole = keyed(F.struct(*keep).alias("kept")) if keep else rows
    part = F.substring("key", 1, RANGE_DIGITS)
    ranges = checkpointed(rows.groupBy("src", part.alias("part")).agg(F.sum("size").alias("n")))
    targets = source_targets(ranges.groupBy("src").agg(F.sum("n").alias("source_size")),
                             weights, most)
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    offsets = (
        ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(targets, "src")
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("left", budget - F.col("epochs") * F.col("source_size"))
        .drop("n")
    )
    inside = (Window.partitionBy("src", "part").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start")))
    return (
        whole.withColumn("part", part).join(offsets, ["src", "part"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target",
                (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), *(["kept"] if keep else []))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every column, and ``taken``; those of which no word is taken go."""
    took = mix(docs, keep=tuple(docs.columns), **options).where("taken > 0")
    return took.select(*[F.col("kept")[c].alias(c) for c in docs.columns], "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)] AS w,
    source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT src, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target FROM l),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.*, e.*, coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN e ON d.src = e.src)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM p
"""


def op8_mix_sources(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
