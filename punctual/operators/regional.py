"""Volume-normalised late rates by city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import exact_sum, mean_of, percent_text

MIN_ORDERS = 30


def city_lateness(features: DataFrame, min_orders: int = MIN_ORDERS) -> DataFrame:
    """Cities with at least ``min_orders`` reviews and a known location.

    The key is the city name alone, so equal names in two states are one city; its location is the
    mean over its reviews. Reviews are added up per city and state in a hash aggregation, so a very
    large city is no hot spot and nothing is sorted; the smallest state name is taken from those
    few rows.
    """
    late, score = F.col("is_late").cast("int"), F.col("review_score")
    lat, lng = F.col("customer_lat"), F.col("customer_lng")
    per_state = (
        features.filter(F.col("customer_city").isNotNull())
        .groupBy("customer_city", "customer_state")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(late).alias("late"),
            F.sum(score).alias("score"),
            F.count(score).alias("n_score"),
            exact_sum(lat).alias("lat"),
            F.count(lat).alias("n_lat"),
            exact_sum(lng).alias("lng"),
            F.count(lng).alias("n_lng"),
        )
    )
    cities = per_state.groupBy("customer_city").agg(
        F.sum("n").alias("n"),
        (F.sum("late") / F.sum("n")).alias("late_rate"),
        mean_of(F.sum("score"), F.sum("n_score")).alias("avg_score"),
        mean_of(F.sum("lat"), F.sum("n_lat")).alias("lat"),
        mean_of(F.sum("lng"), F.sum("n_lng")).alias("lng"),
        F.min("customer_state").alias("state"),
    )
    return cities.filter((F.col("n") >= min_orders) & F.col("lat").isNotNull()).withColumns(
        {
            "late_pct": percent_text(F.col("late_rate")),
            "avg_score_str": F.bround("avg_score", 2).cast("string"),
        }
    )
