"""Order-independent sums and means, and report rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_sum(amount: Column) -> Column:
    """Sum of amounts with up to six decimals, reported as double: the same bits for any partitioning.

    Whole units, and the millionths beyond them, are added as integers, which stays in generated code
    where a wide decimal would not. An amount of any size counts with the six decimals it is written
    with; from 10^9 on, where doubles lie too far apart to subtract, these are read off its shortest
    decimal form. A sum beyond 64 bits fails instead of wrapping.
    """
    value = amount.cast("double")
    whole = F.rint(value)
    written = (value.cast("decimal(30,6)") - whole.cast("decimal(30,6)")) * F.lit(1_000_000)
    beyond = F.when(F.abs(value) < 1e9, F.rint((value - whole) * 1_000_000).cast("bigint")).otherwise(written.cast("bigint"))
    units, millionths = F.sum(whole.cast("bigint")), F.sum(beyond)
    exact = units.cast("decimal(20,0)") + millionths.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    return exact.cast("double")


def exact_sum(value: Column) -> Column:
    """Sum in decimals: the same bits for any partitioning."""
    return F.sum(value.cast("decimal(25,15)"))


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact sum and the number of present values; missing without values."""
    return F.when(count > 0, total.cast("double") / count)


def mean_flag(flag: Column) -> Column:
    """Share of true values."""
    return F.avg(flag.cast("int"))


def percent(share: Column, digits: int = 1) -> Column:
    """Share as a percentage, ties rounded to even."""
    return F.bround(share * 100, digits)


def percent_text(share: Column, digits: int = 1) -> Column:
    return F.concat(percent(share, digits).cast("string"), F.lit("%"))
