"""Company tax ids: 14 digits, 8 base + 4 branch + 2 check digits (modulo 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.text import let

# Weights of the two check digits; the first skips the leading 6.
CHECK_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def _zero_fill(text: Column, width: int) -> Column:
    """Pad on the left; longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def only_digits(raw: Column) -> Column:
    """Digits of the text, padded to 14; no digits stay empty."""
    digits = F.regexp_replace(raw.cast("string"), "[^0-9]", "")
    return let(digits, lambda d: F.when(d == "", d).otherwise(_zero_fill(d, 14)))


def _weighted(number: Column, weights) -> Column:
    """Sum of the twelve digits of a number times their weights."""
    total = None
    for place, weight in enumerate(reversed(weights)):
        digit = F.call_function("div", number, F.lit(10**place)) % 10
        total = digit * weight if total is None else total + digit * weight
    return total


def _digit(total: Column) -> Column:
    """11 minus the remainder; remainders 0 and 1 give 0."""
    return (F.lit(11) - total % 11) % 11 % 10


def check_digits(base: Column) -> Column:
    """Both check digits of a 12-digit base.

    The second one also weighs the first, with the last weight.
    """
    def both(number):
        first = _digit(_weighted(number, CHECK_WEIGHTS[1:]))
        second = _digit(_weighted(number, CHECK_WEIGHTS[:12]) + first * CHECK_WEIGHTS[12])
        return (first * 10 + second).cast("string")

    return F.lpad(let(base.try_cast("bigint"), both), 2, "0")


def _valid_digits(digits: Column) -> Column:
    right = F.substring(digits, 13, 2) == check_digits(F.substring(digits, 1, 12))
    return F.coalesce((F.length(digits) == 14) & right, F.lit(False))


def are_valid(digits: Column) -> Column:
    """``is_valid`` of what ``only_digits`` gave."""
    return let(digits, _valid_digits)


def is_valid(raw: Column) -> Column:
    return are_valid(only_digits(raw))


def masked(raw: Column) -> Column:
    """NN.NNN.NNN/NNNN-NN."""
    return mask(only_digits(raw))


def mask(digits: Column) -> Column:
    """``masked`` of what ``only_digits`` gave."""
    return F.regexp_replace(
        digits, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d*)$", r"$1.$2.$3/$4-$5"
    )


def parts(raw: Column) -> Column:
    """Struct of base (8), branch (4) and the rest."""
    return let(only_digits(raw), lambda d: F.struct(
        F.substring(d, 1, 8).alias("base"),
        F.substring(d, 9, 4).alias("branch"),
        F.substring(d, 13, 1 << 20).alias("check"),
    ))


def joined(base: Column, branch: Column, check: Column) -> Column:
    return F.concat(
        _zero_fill(base.cast("string"), 8),
        _zero_fill(branch.cast("string"), 4),
        _zero_fill(check.cast("string"), 2),
    )


def clean_tax_ids(df: DataFrame, column: str) -> DataFrame:
    """Add digits, masked form, parts, validity and the outcome of the check."""
    d = F.col("digits")
    return (
        df.withColumn("digits", only_digits(F.col(column)))
        .withColumn("is_valid", let(d, _valid_digits))
        .withColumns({
            "masked": masked(d), "parts": parts(d),
            "outcome": F.when(F.coalesce(d, F.lit("")) == "", "empty")
            .when(F.length(d) > 14, "too_long")
            .when(F.col("is_valid"), "valid")
            .otherwise("wrong_check_digits"),
        })
        .select("*", "parts.*").drop("parts")
    )
