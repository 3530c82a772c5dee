"""Writers and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see.

    The cluster names the place in spark.checkpoint.dir.  Only a session on
    one machine may go without and gets a local folder; on a cluster that
    would be a folder of its own on every executor, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="recordsearch-")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rebuild_dataset(docs: DataFrame, path: str, key: str = "file_checksum",
                    partition: str | None = "state_code", parts: int | None = None) -> None:
    """Rewrite the table in its physical order: territory, newest first.

    The ranges are cut by territory, date and key together, so a territory
    with very many documents is spread over several tasks.
    """
    order = [F.col("territory_id").asc(), F.col("date").desc(), F.col(key).asc()]
    lead = [F.col(partition).asc()] if partition else []
    cut = (docs.repartitionByRange(parts, *lead, *order) if parts
           else docs.repartitionByRange(*lead, *order))
    writer = cut.sortWithinPartitions(*lead, *order).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def json_text(fields: list[str], nulls: bool = False) -> Column:
    """The fields as one JSON text; null fields are left out unless ``nulls``."""
    options = {"ignoreNullFields": "false" if nulls else "true",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*fields), options)


def to_response_json(df: DataFrame, keep: tuple[str, ...] = (), nulls: bool = False,
                     name: str = "json") -> DataFrame:
    """Every row as JSON text."""
    return df.select(*keep, json_text([c for c in df.columns if c not in keep], nulls).alias(name))


def write_json(df: DataFrame, path: str, nulls: bool = False) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)
