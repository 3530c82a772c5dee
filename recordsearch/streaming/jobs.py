"""Stream jobs.  The target table, not stream state, is the truth: a batch
that is run again after a failure finds its rows there and adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from recordsearch.operators.ingest import (
    GAZETTE_KEY, created_rows, judge_rows, validate_ingest_rows,
)
from recordsearch.operators.jobstats import append_job_stats, validate_stats_rows


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The target so far; empty before the first batch."""
    empty = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return empty
        raise


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to the end."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def stream_ingest_gazettes(
    rows: DataFrame, territories: DataFrame, target: str, statuses: str, checkpoint: str,
    schema: str, arrival: str = "arrival",
) -> StreamingQuery:
    """Idempotent insert of a stream of rows into a Parquet table.

    Every batch first writes the status of its rows to its own folder below
    ``statuses`` and then appends the created ones to ``target``.  A batch
    that is run again keeps the statuses it has written and appends only what
    the target still lacks.
    """
    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        checked = validate_ingest_rows(batch)
        stored = _stored(spark, target, schema)
        folder = f"{statuses}/batch={number}"
        again = _finished(spark, folder)
        if not again:
            judge_rows(stored, checked, territories, arrival, "errors").write.mode(
                "overwrite").parquet(folder)
        created = created_rows(checked, spark.read.parquet(folder), arrival, errors="errors")
        if again:
            created = created.join(stored.select(*GAZETTE_KEY), list(GAZETTE_KEY), "left_anti")
        created.select(*stored.columns).write.mode("append").parquet(target)

    return (
        rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_job_stats(
    rows: DataFrame, target: str, checkpoint: str, schema: str, arrival: str = "arrival",
    refusals: str | None = None,
) -> StreamingQuery:
    """Append a stream of job statistics, each record with a new id.

    ``arrival`` is unique and kept in the target, so records of a repeated
    batch are known and left out.  Faulty records go to ``refusals``, a folder
    per batch, with the names of their faults.
    """
    def load(batch: DataFrame, number: int) -> None:
        stored = _stored(batch.sparkSession, target, schema)
        checked = validate_stats_rows(batch)
        if refusals:
            checked.where(F.size("errors") > 0).select(arrival, "errors").write.mode(
                "overwrite").parquet(f"{refusals}/batch={number}")
        sound = checked.where(F.size("errors") == 0).drop("errors")
        fresh = sound.join(stored.select(arrival), arrival, "left_anti")
        added = append_job_stats(stored, fresh, arrival)
        added.select(*stored.columns).write.mode("append").parquet(target)

    return (
        rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
