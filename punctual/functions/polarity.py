"""Three-way polarity labels and the parsing of model labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and compound bounds (both inclusive).
NEGATIVE, NEUTRAL, POSITIVE = "negative", "neutral", "positive"
COMPOUND_POSITIVE, COMPOUND_NEGATIVE = 0.05, -0.05


def stars_to_polarity(stars: Column) -> Column:
    """Up to 2 negative, 3 neutral, all else (a missing value too) positive."""
    return F.when(stars <= 2, NEGATIVE).when(stars == 3, NEUTRAL).otherwise(POSITIVE)


def compound_to_polarity(
    compound: Column, pos: float = COMPOUND_POSITIVE, neg: float = COMPOUND_NEGATIVE
) -> Column:
    """Neutral between the bounds and for a missing value; Spark orders NaN above all numbers."""
    return (
        F.when(F.isnan(compound), NEUTRAL)
        .when(compound >= pos, POSITIVE)
        .when(compound <= neg, NEGATIVE)
        .otherwise(NEUTRAL)
    )


def stars_from_label(label: Column) -> Column:
    """The leading number of a model label: ``"4 stars"`` -> 4."""
    return F.split(F.trim(label), r"\s+", 2)[0].cast("int")
