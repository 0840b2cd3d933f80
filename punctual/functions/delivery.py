"""Delivery gap, lateness and the readable gap window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome labels in display order, gap window in days.
ON_TIME, LATE = "On-time", "Late"
OUTCOMES = (ON_TIME, LATE)
GAP_WINDOW = (-30, 60)


def gap_days(estimated: Column, delivered: Column) -> Column:
    """Estimated minus delivered in fractional days; positive is early.

    Both sides are read as zone-less timestamps and subtracted as such, so a clock change of the
    session's zone adds or drops no hour.
    """
    gap = estimated.cast("timestamp_ntz") - delivered.cast("timestamp_ntz")
    return gap.cast("interval second").cast("decimal(18,6)").cast("double") / F.lit(86400.0)


def is_late(gap: Column) -> Column:
    """True below zero; a missing gap counts as on time."""
    return F.coalesce(gap < 0, F.lit(False))


def outcome(late: Column) -> Column:
    return F.when(late, LATE).when(~late, ON_TIME)


def outcome_rank(label: Column) -> Column:
    """Sort key for the fixed display order."""
    return F.when(label == ON_TIME, 0).otherwise(1)


def is_negative(score: Column) -> Column:
    """Scores of 1 and 2; a missing score is not negative."""
    return F.coalesce(score <= 2, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp into [low, high]; a missing value stays missing."""
    return F.when(
        value.isNotNull(),
        F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low))),
    )
