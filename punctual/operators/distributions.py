"""Score shares and gap histograms: the data behind the two quantitative charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.delivery import GAP_WINDOW, OUTCOMES, clip


def score_share_by_outcome(features: DataFrame) -> DataFrame:
    """Share of each score within its outcome; missing scores do not count.

    The window runs over the handful of (outcome, score) counts, not over reviews.
    """
    counts = (
        features.filter(F.col("review_score").isNotNull())
        .groupBy("delivery_outcome", "review_score")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("delivery_outcome"))
    return counts.withColumn("proportion", F.col("n") / total)


def _with_empty_bins(binned: DataFrame, bins: int) -> DataFrame:
    """Add zero counts for every (bin, outcome) and sum up: one aggregation, no join."""
    spark = binned.sparkSession
    grid = (
        spark.range(1, bins + 1)
        .select(
            F.col("id").alias("bin"),
            F.explode(F.array(*[F.lit(o) for o in OUTCOMES])).alias("delivery_outcome"),
            F.lit(0).cast("bigint").alias("n"),
        )
    )
    return (
        binned.select(F.col("bin").cast("bigint").alias("bin"), "delivery_outcome", "n")
        .unionByName(grid)
        .groupBy("bin", "delivery_outcome")
        .agg(F.sum("n").alias("n"))
    )


def gap_histogram_daily(features: DataFrame, window: tuple[int, int] = GAP_WINDOW) -> DataFrame:
    """One-day bins over the clipped window, per outcome; the last bin includes its upper edge."""
    low, high = window
    bins = high - low
    gap = clip(F.col("delivery_gap_days"), low, high)
    # ``least`` skips missing values, so missing gaps go first.
    binned = features.filter(F.col("delivery_gap_days").isNotNull()).select(
        F.least(F.floor(gap - low) + 1, F.lit(bins)).alias("bin"),
        "delivery_outcome",
        F.lit(1).cast("bigint").alias("n"),
    )
    return _with_empty_bins(binned, bins).select(
        "bin",
        (F.col("bin") - 1 + low).cast("double").alias("bin_start"),
        (F.col("bin") + low).cast("double").alias("bin_end"),
        "delivery_outcome",
        "n",
    )


def _edge(index: Column, bins: int) -> Column:
    """Lower edge of the 0-based bin ``index``; the edge after the last bin is the upper bound."""
    step = (F.col("high") - F.col("low")) / bins
    return F.when(index >= bins, F.col("high")).otherwise(F.col("low") + index * step)


def _with_range(frame: DataFrame, bounds: Column) -> DataFrame:
    """Add ``low``, ``high`` and ``total``; a single distinct value gets a unit-wide range."""
    half = F.when(F.col("_b.low") == F.col("_b.high"), F.lit(0.5)).otherwise(F.lit(0.0))
    return frame.withColumn("_b", bounds).select(
        *frame.columns,
        (F.col("_b.low") - half).alias("low"),
        (F.col("_b.high") + half).alias("high"),
        F.col("_b.total").alias("total"),
    )


def gap_histogram_equal_width(
    features: DataFrame, bins: int = 60, window: tuple[int, int] = GAP_WINDOW
) -> DataFrame:
    """Equal-width bins between the smallest and largest clipped gap, shared by both outcomes.

    Bounds and total are one partial aggregate, the bins another one of ``bins`` times two rows:
    no task ever gathers gaps, however many distinct ones there are. ``features`` is read twice,
    gap and outcome only: pass a stored table.
    """
    gaps = features.select(clip(F.col("delivery_gap_days"), *window).alias("gap"), "delivery_outcome").filter(
        F.col("gap").isNotNull()
    )
    bounds = gaps.agg(
        F.struct(
            F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("total")
        ).alias("bounds")
    ).scalar()

    value, guess = F.col("gap"), F.col("guess")
    scaled = (value - F.col("low")) / (F.col("high") - F.col("low")) * bins
    binned = (
        _with_range(gaps, bounds)
        .withColumn("guess", F.least(F.floor(scaled), F.lit(bins - 1)))
        # The guess may be one off at an edge; the edges themselves decide.
        .withColumn(
            "bin",
            F.when(value < _edge(guess, bins), guess)
            .when((value >= _edge(guess + 1, bins)) & (guess < bins - 1), guess + 2)
            .otherwise(guess + 1),
        )
        .groupBy("bin", "delivery_outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    filled = _with_range(_with_empty_bins(binned, bins), bounds)
    return filled.select(
        "bin",
        _edge(F.col("bin") - 1, bins).alias("bin_start"),
        _edge(F.col("bin"), bins).alias("bin_end"),
        "delivery_outcome",
        "n",
        (F.col("n") / F.col("total")).alias("share"),
    )
