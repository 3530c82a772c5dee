"""Catalogue of yearly dump files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.operators.results import file_catalogue_record
from recordsearch.operators.skew import spread_join


def file_catalogue_filter(files: DataFrame, state_code: str, territory_id: str | None = None):
    """Files of a state; without a territory only the state-level ones."""
    place = (F.col("territory_id").isNull() if territory_id is None
             else F.col("territory_id") == territory_id)
    return files.where((F.col("state_code") == state_code.upper()) & place)


def file_catalogue_batch(files: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for a table of (request_id, state_code, territory_id or null)."""
    # a struct keeps "no territory" apart from every name and is joined like any key
    place = F.struct(F.col("territory_id").isNull().alias("none"), F.coalesce("territory_id", F.lit("")).alias("name"))
    asked = requests.select("request_id", F.upper("state_code").alias("_state"), place.alias("_place"))
    listed = files.withColumns({"_state": F.col("state_code"), "_place": place})
    joined = spread_join(asked, listed, ["_state", "_place"], row_id=["request_id"])
    return joined.select(*files.columns, "request_id")


def year_order(ties: tuple[str, ...] = ()) -> list[Column]:
    """Newest year first; rows without a year come before all."""
    return [F.col("year").desc_nulls_first(), *[F.col(c) for c in ties]]


def order_year_desc(df: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(*year_order(ties))


def find_files(files: DataFrame, state_code: str, territory_id: str | None = None,
               endpoint: str = "") -> DataFrame:
    hits = file_catalogue_filter(files, state_code, territory_id)
    return order_year_desc(file_catalogue_record(hits, endpoint))
