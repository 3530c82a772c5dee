"""Joins and ids that keep their balance when one key holds many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def salts(df: DataFrame, keys: list[str]) -> Column:
    """Map from the hash of a hot key to the number of parts its rows are spread over.

    A key gets two parts for each share of the rows that one task of a shuffle
    takes, so it fills no task however hot it is.  Keys with more than half
    such a share are twice as many as there are tasks at most; the map comes
    from a frequent-items sketch of that size, with partial aggregation.
    """
    tasks = shuffle_tasks(df)
    most = 2 * tasks
    top = F.expr(f"approx_top_k(h, {most}, {max(16 * most, 10_000)})")
    listed = df.select(_key_hash(keys).alias("h")).agg(top.alias("top"), F.count("*").alias("n"))
    parts = F.transform("top", lambda t: F.struct(
        t["item"].alias("key"), F.ceil(t["count"] * 2 * tasks / F.col("n")).cast("int").alias("value")))
    hot = F.filter(parts, lambda e: e["value"] > 1)
    return listed.select(F.map_from_entries(hot)).scalar()


def _spread(df: DataFrame, table: DataFrame, keys: list[str], row_id: list[str]):
    """Both sides with the salt of the row and all salts of its key."""
    parts = F.coalesce(F.try_element_at(F.col("_salts"), _key_hash(keys)), F.lit(1))
    own = F.pmod(F.xxhash64(*[F.col(c) for c in row_id]), parts).cast("int")
    found = salts(df, keys)
    left = df.withColumn("_salts", found).withColumn("_salt", own).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    right = table.withColumn("_salts", found).withColumn("_salt", every).drop("_salts")
    return left, right


def lookup(df: DataFrame, table: DataFrame, keys: list[str], row_id: list[str]) -> DataFrame:
    """Left join to a table with one row per key.

    Rows of hot keys are spread by the hash of their own id and only the
    matching table rows are repeated, so no task gets a whole hot key.  The
    salt depends on column values alone: a repeated task gives the same rows.
    """
    left, right = _spread(df, table, keys, row_id)
    return left.join(right, keys + ["_salt"], "left").drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread: bool = True,
                row_id: list[str] | None = None) -> DataFrame:
    """Inner join of a table whose keys may be hot to another.

    Rows of hot keys are spread by the hash of the row's id (of the whole row
    without one); only the other side's rows of these keys are repeated.
    Without ``spread`` it is a plain join, which keeps a stored bucket layout
    of the big side; hot keys are then left to adaptive execution.
    """
    if not spread:
        return big.join(small, keys)
    left, right = _spread(big, small, keys, row_id or big.columns)
    return left.join(right, keys + ["_salt"]).drop("_salt")


def dense_ids(df: DataFrame, order: str, start: Column, name: str, slices: int | None = None,
              cuts_from: DataFrame | None = None) -> DataFrame:
    """Number the rows start+1, start+2, ... in the order of a unique number.

    The column's quantiles (of ``cuts_from``, a cheaper table with the same
    column, when given) cut the rows into slices; each slice is numbered on
    its own and moved by the count of the slices before it.  Only the slice
    counts (at most ``slices`` rows) meet in one place.  There are as many
    slices as a shuffle has tasks unless a number is given.
    """
    slices = slices or max(2, shuffle_tasks(df))
    at = F.col(order).cast("double")
    cuts = (
        (df if cuts_from is None else cuts_from).select(at.alias("v"))
        .agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 100 * slices)
             .alias("cuts"))
        .select("cuts")
        .scalar()
    )
    below = F.size(F.filter("_cuts", lambda c: c < at))
    sliced = df.withColumn("_cuts", F.coalesce(cuts, F.array().cast("array<double>")))
    sliced = sliced.withColumn("_slice", below).drop("_cuts")
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    return (
        sliced.withColumn("_place", inside)
        .join(F.broadcast(offsets), "_slice")  # at most ``slices`` rows
        .withColumn(name, (start + F.col("_offset") + F.col("_place")).cast("long"))
        .drop("_slice", "_place", "_offset")
    )
