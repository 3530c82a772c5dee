"""City census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.text import split_list
from recordsearch.operators.filters import where
from recordsearch.operators.skew import lookup


def name_contains(text: str):
    """Part of the name, upper or lower case alike, accents significant."""
    return F.contains(F.lower("city_name"), F.lower(F.lit(text))) if text else None


def level_in(levels):
    """None, no levels and one blank level mean all."""
    levels = list(levels or [])
    return None if levels in ([], [""]) else F.col("openness_level").isin(*levels)


def city_record(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        F.col("ibge_id").alias("territory_id"),
        F.col("city_name").alias("territory_name"),
        F.col("uf").alias("state_code"),
        split_list(F.col("gazettes_urls")).alias("publication_urls"),
        F.col("openness_level").alias("level"),
        "availability_date",
        *keep,
    )


def find_cities(cities: DataFrame, name: str = "", levels=()) -> DataFrame:
    return city_record(where(cities, name_contains(name), level_in(levels)))


def first_cities(cities: DataFrame, seq: str) -> DataFrame:
    """One row per id, the first in file order."""
    rest = [c for c in cities.columns if c != "ibge_id"]
    first = cities.groupBy("ibge_id").agg(F.min_by(F.struct(*rest), seq).alias("c"))
    return first.select("ibge_id", "c.*")


def lookup_city(requests: DataFrame, cities: DataFrame, id_column: str, row_id: str,
                seq: str = "seq") -> DataFrame:
    """Every requested id with its city; nulls when there is none."""
    table = city_record(first_cities(cities, seq)).withColumn("found", F.lit(True))
    asked = requests.withColumnRenamed(id_column, "territory_id")
    out = lookup(asked, table, ["territory_id"], [row_id])
    return out.withColumn("found", F.coalesce("found", F.lit(False)))
