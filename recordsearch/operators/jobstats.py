"""Statistics of scraping jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.dates import utc_instant
from recordsearch.operators.filters import where, with_problems
from recordsearch.operators.skew import dense_ids

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
    return limit


def job_stats_filter(stats: DataFrame, spider: str | None = None, since: datetime | None = None):
    return where(
        stats,
        None if spider is None else F.col("spider_name") == spider,
        None if since is None else F.col("created_at") >= F.lit(since),
    )


def job_stats_record(df: DataFrame) -> DataFrame:
    return df.select("id", "spider_name", "job_id", "stats", "created_at")


def latest_job_stats(stats: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return job_stats_record(stats).orderBy(*order).limit(check_limit(limit))


def validate_stats_rows(rows: DataFrame) -> DataFrame:
    """``stats`` text parsed to a variant, with the list of failed checks."""
    parsed = rows.withColumn("stats", F.try_parse_json(F.col("stats").cast("string")))
    is_object = F.schema_of_variant(F.col("stats")).startswith("OBJECT")
    return with_problems(parsed, {
        "spider_name": F.col("spider_name").isNotNull(),
        "stats": F.col("stats").isNotNull() & is_object,
    })


def append_job_stats(target: DataFrame, rows: DataFrame, arrival: str, now: Column | None = None):
    """The rows to append, with ids that follow the highest one in use."""
    start = target.select(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = dense_ids(rows.select(arrival), arrival, start, "id")
    stamp = F.current_timestamp() if now is None else now
    return rows.drop("id", "created_at").join(numbered, arrival).withColumn("created_at", stamp)


def migrate_job_stats(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bring a legacy table to the canonical form; returns (table, violations).

    May be repeated: a canonical table stays as it is.
    """
    old_names = {"job_stats": "stats", "start_time": "created_at"}
    for old, new in old_names.items():
        if old in table.columns:
            table = table.withColumnRenamed(old, new)
    for name, kind in (("spider_name", "string"), ("job_id", "string"), ("stats", "variant")):
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    if "created_at" not in table.columns:
        table = table.withColumn("created_at", F.current_timestamp())
    if "spider" in table.columns:
        table = table.withColumn("spider_name", F.coalesce("spider_name", "spider")).drop("spider")
    kinds = dict(table.dtypes)
    if kinds["stats"] == "string":
        table = table.withColumn("stats", F.parse_json("stats"))
    if kinds["created_at"] == "timestamp_ntz":
        table = table.withColumn("created_at", utc_instant(F.col("created_at")))
    whole = F.col("spider_name").isNotNull() & F.col("stats").isNotNull()
    canonical = job_stats_record(table)
    return canonical.where(whole), canonical.where(~whole)
