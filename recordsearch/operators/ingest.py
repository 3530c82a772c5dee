"""Keep document tables up to date: snapshot in, snapshot out.

Choices within a batch (first row of a key, last row of a key) are made on the
narrow keys with partial aggregation, and the wide rows are then picked by
their unique arrival number.  A key that fills a third of a batch therefore
never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.dates import parse_date, parse_iso_datetime
from recordsearch.operators.filters import with_problems
from recordsearch.operators.skew import dense_ids, lookup

GAZETTE_KEY = ("territory_id", "date", "file_checksum")


def bulk_load_latest(current: DataFrame | None, incoming: DataFrame, key: list[str], seq: str):
    """Load by key: a later row replaces the whole earlier one.

    ``seq`` is the unique load order.  Fields the last row lacks become null.
    """
    last = incoming.groupBy(*key).agg(F.max(seq).alias(seq))
    newest = incoming.join(last.select(seq), seq, "left_semi").select(*incoming.columns)
    if current is None:
        return newest
    kept = current.join(last.select(*key), key, "left_anti").select(*current.columns)
    return kept.unionByName(newest, allowMissingColumns=True)


def validate_ingest_rows(rows: DataFrame) -> DataFrame:
    """Typed columns from text rows, with the list of failed checks."""
    typed = rows.withColumns({
        "date": parse_date(F.col("date").cast("string")),
        "scraped_at": parse_iso_datetime(F.col("scraped_at").cast("string")),
    })
    return with_problems(typed, {
        "territory_id": F.col("territory_id").rlike("^[0-9]{7}$"),
        "date": F.col("date").isNotNull(),
        "scraped_at": F.col("scraped_at").isNotNull(),
        "file_path": F.col("file_path").isNotNull(),
        "file_url": F.col("file_url").isNotNull(),
        "file_checksum": F.col("file_checksum").isNotNull(),
    })


def fk_check(rows: DataFrame, territories: DataFrame, row_id: str,
             column: str = "territory_id"):
    """(rows of known territories, rows of unknown ones)."""
    known = territories.select(F.col(territories.columns[0]).alias(column)).distinct()
    flagged = lookup(rows, known.withColumn("_known", F.lit(True)), [column], [row_id])
    return (
        flagged.where(F.col("_known").isNotNull()).select(*rows.columns),
        flagged.where(F.col("_known").isNull()).select(*rows.columns),
    )


def judge_rows(target: DataFrame, rows: DataFrame, territories: DataFrame, arrival: str,
               errors: str | None = None, last_id: Column | None = None) -> DataFrame:
    """Status of every row, with the id of the created ones.

    Unique on territory, date and checksum: the first arrival of a new key is
    created, all others are duplicates.  Rows with entries in the ``errors``
    column are invalid; rows of unknown territories are refused.  ``last_id``
    is the highest id in use, when the caller knows it.
    """
    key = list(GAZETTE_KEY)
    sound = rows.where(F.size(errors) == 0) if errors else rows
    firsts = sound.groupBy(*key).agg(F.min(arrival).alias(arrival))
    # One row per key from here on.
    known = territories.select(F.col(territories.columns[0]).alias("territory_id")).distinct()
    accepted = firsts.join(known, "territory_id", "left_semi")
    # Only the target's rows of the batch's days are read, and of these only
    # keys that occur in the batch go on.
    days = rows.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi")).alias("d")).scalar()
    near = target.select(*key).where(F.col("date").between(days["lo"], days["hi"]))
    seen = near.join(accepted.select(*key), key, "left_semi")
    fresh = accepted.join(seen, key, "left_anti").select(arrival)
    start = last_id
    if start is None:
        start = target.select(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = dense_ids(fresh, arrival, start, "gazette_id", cuts_from=rows)

    problem = F.size(errors) > 0 if errors else F.lit(False)
    narrow = rows.select(arrival, "territory_id", problem.alias("_problem"))
    flagged = lookup(narrow, known.withColumn("_known", F.lit(True)), ["territory_id"], [arrival])
    status = (
        F.when(F.col("_problem"), "invalid")
        .when(F.col("_known").isNull(), "unknown_territory")
        .when(F.col("gazette_id").isNotNull(), "created")
        .otherwise("duplicate")
    )
    return flagged.join(numbered, arrival, "left").select(
        arrival, "gazette_id", status.alias("status")
    )


def created_rows(rows: DataFrame, judged: DataFrame, arrival: str, now: Column | None = None,
                 errors: str | None = None) -> DataFrame:
    """The rows to append: those judged created, with id, time and flag."""
    wanted = [c for c in rows.columns if c not in ("id", "created_at", "processed", errors)]
    ids = judged.where("status = 'created'").select(arrival, F.col("gazette_id").alias("id"))
    return rows.select(*wanted).join(ids, arrival).withColumns({
        "created_at": F.localtimestamp() if now is None else now,
        "processed": F.lit(False),
    })


def ingest_gazettes(
    target: DataFrame, rows: DataFrame, territories: DataFrame, arrival: str,
    now: Column | None = None, errors: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Idempotent insert; returns (new rows with ids, status of every input row).

    Appending the new rows to the target gives the next snapshot.
    """
    judged = judge_rows(target, rows, territories, arrival, errors)
    return created_rows(rows, judged, arrival, now, errors), judged
