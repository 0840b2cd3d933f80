"""The wide review-grain table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOLD_COLUMNS = (
    "review_id",
    "order_id",
    "review_score",
    "review_comment_title",
    "review_comment_message",
    "has_text",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "customer_unique_id",
    "customer_state",
    "customer_zip_code_prefix",
    "customer_city",
    "customer_lat",
    "customer_lng",
    "n_items",
    "n_sellers",
    "items_total",
    "freight_total",
    "payment_total",
    "max_installments",
)


def order_facts(
    clean: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    centroids: DataFrame,
) -> DataFrame:
    """Everything known about a delivered order, at order grain.

    Basket and payment summaries come out of their aggregation partitioned by ``order_id``, so
    only the orders themselves are shuffled for both left joins. Zip points are attached to the
    customers, the smaller side, so no order moves by zip. Customer and zip joins carry no hint: a
    small side is broadcast by its measured size, a large one is sort-merged, with hot customers
    and zips split at run time.
    """
    customer = customers.select(
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "customer_zip_code_prefix",
        "customer_city",
    )
    centroid = centroids.select(
        F.col("zip_prefix").alias("customer_zip_code_prefix"),
        F.col("lat").alias("customer_lat"),
        F.col("lng").alias("customer_lng"),
    )
    return (
        clean.drop("order_status")
        .join(items, "order_id", "left")
        .join(payments.drop("n_payments"), "order_id", "left")
        .join(customer.join(centroid, "customer_zip_code_prefix", "left"), "customer_id", "inner")
    )


def gold_reviews(
    dedup: DataFrame,
    clean: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    centroids: DataFrame,
) -> DataFrame:
    """One row per review.

    Order facts are assembled first, so the reviews meet them in a single join whose two inputs
    are plain shuffles: the shape in which Spark can split an order id with very many reviews.
    Left joins whose columns a reader does not select are removed by the optimizer, because the
    summaries are unique by their key. Reviews that come without their text give a gold table
    without it.
    """
    if "has_text" not in dedup.columns:
        dedup = dedup.withColumn("has_text", F.col("review_comment_message").isNotNull())
    facts = order_facts(clean, customers, items, payments, centroids)
    joined = dedup.join(facts, "order_id", "inner")
    kept = [c for c in GOLD_COLUMNS if c in joined.columns]
    return joined.select(*kept, *[c for c in ("_row",) if c in joined.columns])


def grain_check(gold: DataFrame) -> DataFrame:
    """Row count, distinct review ids and whether they are equal.

    The ids are counted first, so one hot id is one row of the second aggregation.
    """
    per_id = gold.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_review_ids"),
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("is_unique"),
    )
