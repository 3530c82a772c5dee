"""Row filters.  Absent conditions add nothing to the plan."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.operators.skew import spread_join

OPENNESS_LEVELS = ("0", "1", "2", "3")
SORT_MODES = ("relevance", "descending_date", "ascending_date")


def all_of(*conditions: Column | None) -> Column | None:
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    condition = all_of(*conditions)
    return df if condition is None else df.where(condition)


def terms(column: str, values) -> Column | None:
    """The column equals any of the values; no values, no condition."""
    values = list(values or [])
    return F.col(column).isin(*values) if values else None


def terms_from(df: DataFrame, column: str, ids: DataFrame, id_column: str,
               row_id: list[str] | None = None) -> DataFrame:
    """The same for a table of values; ``row_id`` spreads values with very many rows."""
    wanted = ids.select(F.col(id_column).alias(column)).distinct()
    return spread_join(df, wanted, [column], row_id=row_id).select(*df.columns)


def array_any(column: str, values) -> Column | None:
    """Any element of the array is one of the values."""
    values = list(values or [])
    if not values:
        return None
    return F.coalesce(F.exists(column, lambda x: F.coalesce(x.isin(*values), F.lit(False))),
                      F.lit(False))


def date_range(column: str, since: date | None = None, until: date | None = None) -> Column | None:
    """Inclusive; either end may be open."""
    return all_of(
        None if since is None else F.col(column) >= F.lit(since),
        None if until is None else F.col(column) <= F.lit(until),
    )


def _no_zone(at: datetime) -> Column:
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(at.isoformat()).cast("timestamp_ntz")


def datetime_range(
    column: str,
    since: datetime | None = None,
    until: datetime | None = None,
    whole_second: bool = True,
) -> Column | None:
    """Inclusive; bounds with a zone are taken in UTC.

    With ``whole_second`` an upper bound without a fraction reaches to the end
    of its second.
    """
    upper = None
    if until is not None:
        if whole_second and until.microsecond == 0:
            upper = F.col(column) < _no_zone(until + timedelta(seconds=1))
        else:
            upper = F.col(column) <= _no_zone(until)
    return all_of(None if since is None else F.col(column) >= _no_zone(since), upper)


def bool_compose(df: DataFrame, must=(), filter=(), should=(), must_not=(), score: str = "score"):
    """Combine clauses into membership and a score.

    ``must`` and ``should`` are (condition, score) pairs.  With a must or
    filter clause, should clauses only add score; alone, one of them has to
    hold.  No clause at all leaves the table as it is.
    """
    if not (must or filter or should or must_not):
        return df
    holds = lambda c: F.coalesce(c, F.lit(False))
    conditions = [holds(c) for c, _ in must] + [holds(c) for c in filter]
    conditions += [~holds(c) for c in must_not]
    if should and not (must or filter):
        conditions.append(reduce(lambda a, b: a | b, [holds(c) for c, _ in should]))
    total = F.lit(0.0)
    for _, points in must:
        total = total + points
    for condition, points in should:
        total = total + F.when(holds(condition), points).otherwise(0.0)
    return where(df, *conditions).withColumn(score, total)


def match_none(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def match_all(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn(score, F.lit(1.0))


def with_problems(df: DataFrame, checks: dict[str, Column], name: str = "errors") -> DataFrame:
    """Add the names of the checks that fail, in the order given."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(label)) for label, ok in checks.items()]
    return df.withColumn(name, F.array_compact(F.array(*failed)))


def split_valid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with errors)."""
    return df.where(F.size(errors) == 0).drop(errors), df.where(F.size(errors) > 0)


def enum_check(df: DataFrame, column: str, allowed=OPENNESS_LEVELS, strict: bool = False):
    """(rows with an allowed value, other rows); an error at run time if strict."""
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    if strict:
        message = F.concat(F.lit(f"{column} not allowed: "), F.coalesce(column, F.lit("null")))
        stop = F.when(ok, F.col(column)).otherwise(F.raise_error(message))
        return df.withColumn(column, stop), df.where(F.lit(False))
    return df.where(ok), df.where(~ok)


def check_sort_mode(mode: str) -> str:
    if mode not in SORT_MODES:
        raise ValueError(f"sort mode not allowed: {mode}")
    return mode
