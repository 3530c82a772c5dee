"""Result rows of the searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.text import text_or_null
from recordsearch.functions.urls import FileStore, build_file_url


def _excerpts(df: DataFrame):
    none = F.array().cast("array<string>")
    return F.coalesce(F.col("excerpts"), none) if "excerpts" in df.columns else none


def gazette_result(df: DataFrame, store: FileStore = FileStore(), public: bool = False,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    raw_text = F.when(F.col("file_raw_txt") != "", F.col("file_raw_txt"))
    out = df.select(
        "territory_id",
        F.col("date").cast("date").alias("date"),
        F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"),
        build_file_url(F.col("url"), store).alias("url"),
        "territory_name",
        "state_code",
        _excerpts(df).alias("excerpts"),
        F.col("edition_number").alias("edition"),
        "is_extra_edition",
        F.when(raw_text.isNotNull(), build_file_url(raw_text, store)).alias("txt_url"),
        "file_checksum",
        *keep,
    )
    return out.drop("file_checksum") if public else out


def excerpt_result(df: DataFrame, store: FileStore = FileStore(), public: bool = False,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    raw_text = F.when(F.col("source_file_raw_txt") != "", F.col("source_file_raw_txt"))
    marked = F.try_element_at(_excerpts(df), F.lit(1))
    out = df.select(
        "excerpt_id",
        "theme",
        F.col("source_territory_id").alias("territory_id"),
        F.col("source_date").cast("date").alias("date"),
        F.col("source_scraped_at").cast("timestamp_ntz").alias("scraped_at"),
        build_file_url(F.col("source_url"), store).alias("url"),
        F.col("source_territory_name").alias("territory_name"),
        F.col("source_state_code").alias("state_code"),
        F.col("excerpt_subthemes").alias("subthemes"),
        F.coalesce("excerpt_entities", F.array().cast("array<string>")).alias("entities"),
        F.coalesce(marked, F.col("excerpt")).alias("excerpt"),
        F.col("source_edition_number").alias("edition"),
        F.col("source_is_extra_edition").alias("is_extra_edition"),
        F.when(raw_text.isNotNull(), build_file_url(raw_text, store)).alias("txt_url"),
        *keep,
    )
    return out.drop("excerpt_id", "theme") if public else out


def distinct_results(df: DataFrame, fields: list[str] | None = None,
                     as_sets: tuple[str, ...] = ()) -> DataFrame:
    """One row per set of equal fields; the named arrays count as sets."""
    fields = fields or df.columns
    shaped = df.select(*[
        F.array_sort(F.array_distinct(c)).alias(c) if c in as_sets else F.col(c) for c in fields
    ])
    return shaped.distinct()


def file_catalogue_record(df: DataFrame, endpoint: str = "") -> DataFrame:
    """The path is only put behind the endpoint text; a missing path stays null."""
    return df.select(
        *[text_or_null(F.col(c)).alias(c) for c in ("territory_id", "state_code")],
        F.concat(F.lit(endpoint), text_or_null(F.col("file_path"))).alias("file_path"),
        *[text_or_null(F.col(c)).alias(c)
          for c in ("year", "hash_info", "file_size_mb", "last_updated")],
    )
