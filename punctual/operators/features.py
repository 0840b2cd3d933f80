"""Analytical columns over gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import delivery


def add_features(gold: DataFrame) -> DataFrame:
    """Gap, lateness, outcome label and negativity; ``has_text`` may arrive as boolean or 0/1."""
    gap = delivery.gap_days(
        F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date")
    )
    return (
        gold.withColumns({"has_text": F.col("has_text").cast("boolean"), "delivery_gap_days": gap})
        .withColumns(
            {
                "is_late": delivery.is_late(F.col("delivery_gap_days")),
                "is_negative": delivery.is_negative(F.col("review_score")),
            }
        )
        .withColumn("delivery_outcome", delivery.outcome(F.col("is_late")))
    )


def text_reviews(features: DataFrame) -> DataFrame:
    """The reviews the sentiment methods score."""
    return features.filter("has_text").select("review_id", "review_comment_message", "review_score")


def negative_text_reviews(features: DataFrame) -> DataFrame:
    """The reviews the labeler may see."""
    return features.filter(F.col("is_negative") & F.col("has_text")).select(
        "review_id", "review_comment_message"
    )
