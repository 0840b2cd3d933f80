"""Data-quality facts and headline rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import mean_flag, percent


def review_key_profile(order_reviews: DataFrame) -> DataFrame:
    """Raw reviews: rows, distinct ids, rows with text. One row per id after the first shuffle."""
    per_id = order_reviews.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("review_comment_message").alias("n_text")
    )
    return per_id.agg(
        F.sum("n").alias("n_rows"),
        F.count("review_id").alias("n_review_ids"),
        F.sum("n_text").alias("n_with_text"),
    )


def excluded_by_status(orders: DataFrame) -> DataFrame:
    """Orders without a delivery date, by status."""
    return (
        orders.filter(F.col("order_delivered_customer_date").isNull())
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )


def one_time_buyers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Percentage of customers with exactly one order; missing without customers.

    Orders are counted per customer key before the join, so a customer with very many orders is
    one row in it.
    """
    per_key = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_customer = (
        per_key.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "inner")
        .groupBy("customer_unique_id")
        .agg(F.sum("n").alias("n"))
    )
    return per_customer.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.round(
            F.try_divide(F.lit(100.0) * F.count_if(F.col("n") == 1).cast("double"), F.count(F.lit(1))), 1
        ).alias("one_time_pct"),
    )


def score_by_outcome(features: DataFrame, digits: int = 2) -> DataFrame:
    """Mean score per delivery outcome."""
    return features.groupBy("delivery_outcome").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.bround(F.avg("review_score"), digits).alias("mean_score"),
    )


def headline_rates(features: DataFrame) -> DataFrame:
    """Late and negative percentages over all reviews."""
    return features.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        percent(mean_flag(F.col("is_late"))).alias("late_pct"),
        percent(mean_flag(F.col("is_negative"))).alias("negative_pct"),
    )


def column_sum(frame: DataFrame, column: str, alias: str = "s") -> DataFrame:
    """Global sum of one column."""
    return frame.agg(F.sum(column).alias(alias))
