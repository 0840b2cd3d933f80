"""Groups whose late rate stands out: shrinkage towards the common rate, and funnel limits.

Both start from one row per group (``group_rates``): its size ``n`` and its late reviews ``late``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.numeric import exact_sum
from punctual.functions.special import beta_quantile, binomial_at_least, binomial_at_most, bound, digamma_step, folded, number, trigamma_step

#: Newton steps of the prior, the longest of them, and bounds of its strength (beyond the upper one groups are alike).
STEPS, LONGEST_STEP = 14, 2.0
WEAKEST, STRONGEST = 1e-2, 1e5
#: Chance outside the shrunk interval and outside the funnel, and the accepted share of false discoveries.
OUTSIDE, FALSE_SHARE = 0.05, 0.05


def group_rates(features: DataFrame, key: str = "customer_city") -> DataFrame:
    """(key, n, late) of every group with a name."""
    return (
        features.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("is_late").cast("bigint")), F.lit(0)).alias("late"))
    )


class Prior(NamedTuple):
    """A beta distribution of group rates."""

    alpha: float
    beta: float


def newton_step(mean: float, strength: float, sums: tuple[float, ...]) -> tuple[float, float]:
    """One guarded Newton step of the likelihood in logit of the mean and log of the strength.

    ``sums`` are the sums over groups of the digamma steps from alpha by the late ones, from beta by
    the others, from alpha + beta by all, and the same of the trigamma steps. Where the likelihood is
    not curved downwards the step is the longest one uphill.
    """
    a1, b1, c1, a2, b2, c2 = sums
    alpha, beta = mean * strength, (1 - mean) * strength
    slope_a, slope_b = a1 - c1, b1 - c1
    spread = strength * mean * (1 - mean)
    g_mean = spread * (slope_a - slope_b)
    g_strength = alpha * slope_a + beta * slope_b
    h_mean = spread**2 * (a2 + b2) + spread * (1 - 2 * mean) * (slope_a - slope_b)
    h_strength = alpha**2 * a2 + beta**2 * b2 - strength**2 * c2 + g_strength
    h_both = spread * (alpha * a2 - beta * b2) + spread * (slope_a - slope_b)
    determinant = h_mean * h_strength - h_both**2
    if h_mean < 0 and determinant > 0:
        move_mean = (h_both * g_strength - h_strength * g_mean) / determinant
        move_strength = (h_both * g_mean - h_mean * g_strength) / determinant
    else:
        move_mean = -g_mean / h_mean if h_mean < 0 else 0.0
        move_strength = math.copysign(LONGEST_STEP, g_strength)
    if strength >= STRONGEST and h_mean < 0:
        # At the bound the strength hardly matters, and what it says about the mean is rounding.
        move_mean = -g_mean / h_mean
    move_mean = max(-LONGEST_STEP, min(LONGEST_STEP, move_mean))
    move_strength = max(-LONGEST_STEP, min(LONGEST_STEP, move_strength))
    logit = math.log(mean / (1 - mean)) + move_mean
    return 1 / (1 + math.exp(-logit)), max(WEAKEST, min(STRONGEST, strength * math.exp(move_strength)))


def fit_prior(groups: DataFrame, steps: int = STEPS) -> Prior:
    """The beta prior under which the groups' late counts are likeliest.

    Groups of one size and count weigh together, so a step is one aggregate of at most as many rows
    as there are different pairs; its sums are decimals, the same for any partitioning. Empty groups
    say nothing; groups of one row tell the mean, not the strength, and without larger groups the
    strength stays where the steps begin, at 10. ``groups`` is read once per step: pass a stored
    table. Without any row the prior is the uniform one.
    """
    pairs = groups.filter("n > 0").groupBy("n", "late").agg(F.count(F.lit(1)).alias("w"))
    total = pairs.agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("late") * F.col("w")).alias("late")).first()
    if not total.n:
        return Prior(1.0, 1.0)
    mean, strength = (total.late + 0.5) / (total.n + 1.0), 10.0
    for _ in range(steps):
        starts = (mean * strength, "late"), ((1 - mean) * strength, "(n - late)"), (strength, "n")
        terms = [F.expr(f"{f(number(x), m)} * w") for f in (digamma_step, trigamma_step) for x, m in starts]
        sums = pairs.agg(*[exact_sum(t).cast("double").alias(f"s{i}") for i, t in enumerate(terms)]).first()
        mean, strength = newton_step(mean, strength, tuple(sums))
    return Prior(mean * strength, (1 - mean) * strength)


def shrunk_rates(groups: DataFrame, prior: Prior | None = None, outside: float = OUTSIDE) -> DataFrame:
    """Adds late_rate (missing for an empty group), prior_mean, prior_strength, shrunk_rate, low and high.

    The shrunk rate is the mean of the group's rate after seeing its reviews, [low, high] leaves half
    of ``outside`` on either side. A large group keeps its own rate, an empty one has the prior's.
    """
    prior = prior or fit_prior(groups)
    strength = prior.alpha + prior.beta
    alpha, beta = f"(late + {number(prior.alpha)})", f"(n - late + {number(prior.beta)})"
    return groups.withColumns(
        {
            "late_rate": F.try_divide(F.col("late").cast("double"), F.col("n").cast("double")),
            "prior_mean": F.lit(prior.alpha / strength),
            "prior_strength": F.lit(strength),
            "shrunk_rate": F.expr(f"{alpha} / (n + {number(strength)})"),
            "low": F.expr(beta_quantile(outside / 2, alpha, beta)),
            "high": F.expr(beta_quantile(1 - outside / 2, alpha, beta)),
        }
    )


def _limit(fits: Callable[[str], str]) -> str:
    """The least count c in 0..n that ``fits``, which holds from some count on; n + 1 if none does. By halving."""

    def halved(state: str, _: str) -> str:
        def moved(m: str) -> str:
            return bound(fits(m), lambda ok: f"struct(IF({ok}, {state}.low, {m} + 1) AS low, IF({ok}, {m}, {state}.high) AS high)")

        middle = bound(f"({state}.low + {state}.high) div 2", moved)
        return f"IF({state}.low >= {state}.high, {state}, {middle})"

    start = "struct(CAST(0 AS BIGINT) AS low, CAST(n + 1 AS BIGINT) AS high)"
    return f"{folded('ceil(log2(n + 2)) + 1', start, halved)}.low"


#: p values are dealt to so many ranges per halving, for ranks without a global sort.
RANGES = 256


def _false_discovery(tested: DataFrame, p_value: str) -> DataFrame:
    """(p_value, rank, q_value) of every different p value, by Benjamini and Hochberg.

    ``rank`` counts the groups with at most this p value. Equal values are one row. Counts and
    smallest values of ranges of p (equally wide in the logarithm) are the only rows that meet in one
    task, at most ``RANGES`` for each of the 1,075 halvings of a double; ranks are running sums inside
    a range behind those of the ranges before it.
    """
    halvings = F.when(F.col(p_value) > 0, -F.log2(p_value)).otherwise(1_080)
    distinct = tested.groupBy(p_value).agg(F.count(F.lit(1)).alias("_w")).withColumn("_range", -F.floor(halvings * RANGES).cast("bigint"))
    ranges = distinct.groupBy("_range").agg(F.sum("_w").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_m"))
    up_to = Window.partitionBy("_range").orderBy(p_value)
    ranked = (
        distinct.join(ranges, "_range")
        .withColumn("rank", F.col("_before") + F.sum("_w").over(up_to))
        .withColumn("_q", F.least(F.col(p_value) * F.col("_m") / F.col("rank"), F.lit(1.0)))
    )
    # The least ratio from here on: inside the range, and among the ranges behind it.
    least = ranked.groupBy("_range").agg(F.min("_q").alias("_least"))
    behind = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    least = least.select("_range", F.min("_least").over(behind).alias("_behind"))
    onwards = up_to.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.join(least, "_range").select(
        p_value, "rank", F.least(F.min("_q").over(onwards), F.coalesce("_behind", F.lit(1.0))).alias("q_value")
    )


def funnel(groups: DataFrame, outside: float = OUTSIDE, false_share: float = FALSE_SHARE) -> DataFrame:
    """Exact binomial control limits of the common late rate, p values and false-discovery control.

    Adds baseline (the late rate of all groups together), low_rate and high_rate (a group of this
    size within them has at least ``outside`` / 2 on either side), p_value (twice the smaller tail,
    at most 1), rank and q_value among all groups, and outlier: ``high``, ``low`` or ``no`` by q_value.
    Empty groups cannot stand out and are left out. ``groups`` is read four times: pass a stored table.
    """
    present = groups.filter("n > 0")
    total = present.agg(F.struct(F.sum("late").alias("late"), F.sum("n").alias("n")).alias("t")).scalar()
    half = outside / 2
    tested = (
        present.withColumn("_t", total)
        .withColumn("baseline", F.col("_t.late").cast("double") / F.col("_t.n").cast("double"))
        .drop("_t")
        .withColumns({
                "late_rate": F.expr("late / n"),
                "_up": F.expr(binomial_at_least("late", "n", "baseline")),
                "_down": F.expr(binomial_at_most("late", "n", "baseline")),
            })
        .withColumn("p_value", F.least(2 * F.least("_up", "_down"), F.lit(1.0)))
    )
    ranks = _false_discovery(tested.select("p_value"), "p_value")
    # The least count with enough weight at or below it, and the largest with enough at or above it.
    lowest = _limit(lambda c: f"{binomial_at_most(c, 'n', 'baseline')} > {number(half)}")
    highest = _limit(lambda c: f"{binomial_at_least(c, 'n', 'baseline')} <= {number(half)}")
    side = F.when(F.col("q_value") > false_share, "no").when(F.expr("late / n > baseline"), "high").otherwise("low")
    return (
        tested.join(ranks, "p_value")
        .withColumns({"low_rate": F.expr(f"{lowest} / n"), "high_rate": F.expr(f"({highest} - 1) / n"), "outlier": side})
        .drop("_up", "_down")
    )
