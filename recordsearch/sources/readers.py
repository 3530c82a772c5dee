"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsearch import schemas


def scan_documents(spark: SparkSession, name: str = "", default: str = "",
                   schema: str | None = schemas.GAZETTES) -> DataFrame:
    """The document table or folder; an empty name means the default one."""
    name = name if isinstance(name, str) and name else default
    if "/" not in name:
        if not spark.catalog.tableExists(name):
            raise ValueError(f'Index "{name}" does not exist')
        return spark.table(name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(name)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise ValueError(f'Index "{name}" does not exist') from problem
        raise


def scan_cities_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column text; ``seq`` orders by file name, then line."""
    raw = (
        spark.read.schema(schemas.CITIES)
        .options(header=True, multiLine=True, escape='"', mode="PERMISSIVE")
        .option("nullValue", "\u0000").option("emptyValue", "")
        .csv(path)
    )
    return raw.select("*", _file_order()).na.fill("")


def _file_order():
    """Grows with file name and place in the file, however files are packed in tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.monotonically_increasing_id().alias("line")).alias("seq")


def scan_theme_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per theme of the JSON catalogues, in order."""
    raw = spark.read.schema(schemas.THEME_CATALOGUE).option("multiLine", multi_line).json(path)
    rows = raw.select(_file_order(), F.posexplode("themes").alias("pos", "t"))
    return rows.select(F.struct("seq.file", "seq.line", "pos").alias("seq"), "t.*")


def scan_relational(spark: SparkSession, url: str, table: str, key: str | None = None,
                    bounds: tuple[int, int] | None = None, partitions: int = 16,
                    predicates: list[str] | None = None, **properties) -> DataFrame:
    """A database table, read by several tasks; filters and columns are pushed down.

    Parts come from ``predicates`` or from a numeric key and its bounds.
    """
    properties = {k: str(v) for k, v in properties.items()}
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1],
                                numPartitions=partitions)
    return reader.load()


def select_rows(table: DataFrame, data: dict | None = None) -> DataFrame:
    """Parameterised row fetch: every named column equals its value.

    Pushed down to whatever the table is read from, a database included; as in
    SQL, nothing equals null.
    """
    for name, value in (data or {}).items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt anew to ``tasks`` tasks, for a caller whose files cannot be split.

    Without a number rows stay where they are; nothing depends on their size.
    """
    return df.repartition(tasks) if tasks else df
