"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session may go without; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = context.getCheckpointDir()
    if known is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name below the shared one that nobody used before."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder; Spark deletes them when unused.

    Keep what is checkpointed narrow: rows are stored whole.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """Checkpointed rows whose size the planner does not carry on from the plan they replace.

    A checkpoint keeps the size estimate of its plan, and a join multiplies
    those of its sides: a loop of joins makes numbers of millions of digits.
    A table made of the checkpoint's rows starts with no estimate.
    """
    rows = checkpointed(df)
    made = df.sparkSession._jsparkSession.createDataFrame(rows._jdf.javaRDD(), rows._jdf.schema())
    return DataFrame(made, df.sparkSession)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows written as Parquet to the shared folder and read back; the folder stays until its owner deletes it."""
    folder = folder or new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts(df: DataFrame) -> int:
    """Tasks of a shuffle; given as a number, small rows that mean much work are not put together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def attach(left: DataFrame, right: DataFrame, key: str, spread: str, weight: str) -> DataFrame:
    """Left join to a table with one row per key where some keys are hot.

    ``right`` says in ``weight`` how many left rows its key has.  Keys with
    more than a P-th of all left rows (P: shuffle partitions) are at most P,
    so this part of ``right`` is broadcast, whatever the data size.  The rest
    is shuffled on the key; left rows that are served already are dealt by
    ``spread`` instead.  ``right`` should be checkpointed: it is read twice.
    ``weight`` is not in the result.
    """
    names = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    limit = max(total // parts(left), 1)
    packed = right.select(key, weight, F.struct(*names).alias("_v"))
    hot = packed.where(F.col(weight) > limit).select(F.col(key), F.col("_v").alias("_hot"))
    cold = packed.where(F.col(weight) <= limit).select(
        F.struct(F.lit(0).alias("h"), F.col(key).cast("string").alias("k")).alias("_k"),
        F.col("_v").alias("_cold"))
    served = left.join(F.broadcast(hot), key, "left")
    own = F.when(
        F.col("_hot").isNull() & F.col(key).isNotNull(),
        F.struct(F.lit(0).alias("h"), F.col(key).cast("string").alias("k")),
    ).otherwise(F.struct(F.lit(1).alias("h"), F.col(spread).cast("string").alias("k")))
    joined = served.withColumn("_k", own).join(cold, "_k", "left")
    value = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *[value[c].alias(c) for c in names])
