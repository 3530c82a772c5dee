"""Dates and instants from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"


def parse_date(text: Column, strict: bool = False) -> Column:
    """yyyy-MM-dd.  Bad text is null, or an error when ``strict``."""
    if strict:
        return F.to_date(text, "yyyy-MM-dd")
    return F.when(text.rlike(DATE_TEXT), F.try_to_date(text, "yyyy-MM-dd"))


def parse_iso_datetime(text: Column, strict: bool = False) -> Column:
    """ISO date and time without a zone.  Bad text is null, or an error."""
    if strict:
        return text.cast("timestamp_ntz")
    return text.try_cast("timestamp_ntz")


def utc_instant(local: Column) -> Column:
    """Zone-less time read as UTC, whatever the session time zone is."""
    return F.make_timestamp_ltz(
        F.year(local), F.month(local), F.dayofmonth(local), F.hour(local), F.minute(local),
        F.date_part(F.lit("SECOND"), local), F.lit("UTC"),
    )
