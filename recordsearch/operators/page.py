"""Order, pages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.operators.filters import check_sort_mode


def sort_columns(
    mode: str = "relevance",
    date: str = "date",
    score: str = "score",
    ties: tuple[str, ...] = ("territory_id", "file_checksum"),
) -> list[Column]:
    """Full ordering of hits; rows without a date come last both ways."""
    check_sort_mode(mode)
    tie_order = [F.col(c).asc_nulls_last() for c in ties]
    if mode == "ascending_date":
        return [F.col(date).asc_nulls_last(), *tie_order]
    if mode == "descending_date":
        return [F.col(date).desc_nulls_last(), *tie_order]
    return [F.col(score).desc_nulls_last(), tie_order[0],
            F.col(date).desc_nulls_last(), *tie_order[1:]]


def paginate(df: DataFrame, order: list[Column], offset: int = 0, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def placed(df: DataFrame, order: list[Column], folder: str, name: str = "place") -> DataFrame:
    """Every row with its place in a full order, from 1; the rows are kept in ``folder``, cut into sorted ranges.

    Ranges are numbered on their own and moved by the rows before them, so no
    task has all rows.  A page of any depth is then a filter on the place.
    Rows that are equal in the order have any of their places.
    """
    cut = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut.sortWithinPartitions(*order).write.parquet(folder)  # once, so places and counts see the same ranges
    rows = df.sparkSession.read.schema(cut.schema).parquet(folder)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each task
    listed = counts.agg(F.map_from_entries(F.collect_list(F.struct("_range", "_n"))).alias("m"))
    numbered = rows.withColumn("_counts", listed.scalar()).withColumn(
        "_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    before = F.aggregate(F.map_values(F.map_filter("_counts", lambda r, n: r < F.col("_range"))), F.lit(0).cast("long"), lambda a, n: a + n)
    return numbered.withColumn(name, before + F.col("_place")).drop("_counts", "_place", "_range")


def page_of(placed_rows: DataFrame, offset: int = 0, size: int = 10, name: str = "place") -> DataFrame:
    """The page of rows that have their places, however deep; nothing before it is gathered."""
    return placed_rows.where(F.col(name).between(offset + 1, offset + size)).orderBy(name)


def continue_after(df: DataFrame, order: list[tuple[str, bool]], last: dict, size: int = 10) -> DataFrame:
    """The page behind a given row: the first ``size`` rows after the values ``last`` of the order's columns.

    ``order`` names columns and whether each ascends; nulls come last.  The
    columns together must tell rows apart.
    """
    later, same = F.lit(False), F.lit(True)
    for column, ascending in order:
        value, here = last[column], F.col(column)
        if value is not None:
            beyond = here > F.lit(value) if ascending else here < F.lit(value)
            later = later | (same & (F.coalesce(beyond, F.lit(False)) | here.isNull()))
        same = same & here.eqNullSafe(F.lit(value))
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    return df.where(later).orderBy(*by).limit(size)


def topk_per_group(
    df: DataFrame, group: list[str], order: list[Column], offset: int = 0, size: int = 10,
    row_id: list[str] | None = None, rank: str = "rank",
) -> DataFrame:
    """The page of every group, with the rank.

    With a row id, pages of any depth are first cut within salted parts of
    each group, as many as a shuffle has tasks, so a large group is never
    sorted in one task.
    """
    last = offset + size
    if row_id:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in row_id]), F.lit(tasks))
        part = Window.partitionBy(*group, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", salt)
            .withColumn("_place", F.row_number().over(part))
            .where(F.col("_place") <= last)
            .drop("_part", "_place")
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    page = ranked.where(F.col(rank) <= last)
    return page.where(F.col(rank) > offset) if offset else page


def total_hits(df: DataFrame, by: list[str] | None = None, cap: int | None = None,
               name: str = "total") -> DataFrame:
    """Exact number of hits before paging, overall or per query; ``cap`` is optional."""
    n = F.count("*")
    if cap is not None:
        n = F.least(n, F.lit(cap))
    return (df.groupBy(*by) if by else df).agg(n.cast("long").alias(name))


def page_counts(page: DataFrame, name: str) -> DataFrame:
    """Number of rows returned, after the limit."""
    return page.agg(F.count("*").alias(name))
