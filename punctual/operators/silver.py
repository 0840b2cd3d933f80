"""Cleaning and grain resolution of the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.numeric import exact_sum, mean_of, money_sum


def orders_clean(orders: DataFrame) -> DataFrame:
    """Orders with a delivery date. The date decides, not the status."""
    return orders.filter(F.col("order_delivered_customer_date").isNotNull()).select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )


#: What a review says; everything else about it is narrow.
TEXT_COLUMNS = ("review_comment_title", "review_comment_message")
#: A source may bring these along, taken where the text is stored, so that no text moves for them.
DERIVED_COLUMNS = ("has_text", "text_digest")
#: Orders the columns of ``TEXT_COLUMNS`` of otherwise equal rows; the same in SQL statements.
TEXT_DIGEST = "md5(concat_ws('|', {}))".format(", ".join(f"coalesce(concat('1', {c}), '0')" for c in TEXT_COLUMNS))
#: True for a row with any of ``TEXT_COLUMNS``, by its digest alone.
HAS_ANY_TEXT = "text_digest <> md5('{}')".format("|".join("0" for _ in TEXT_COLUMNS))


def source_columns(order_reviews: DataFrame) -> list[str]:
    return [c for c in order_reviews.columns if c not in DERIVED_COLUMNS]


def with_derived(order_reviews: DataFrame) -> DataFrame:
    """Adds ``has_text``, ``text_digest`` and ``_row``, a key of review, order and text."""
    derived = {"has_text": F.col("review_comment_message").isNotNull(), "text_digest": F.expr(TEXT_DIGEST)}
    frame = order_reviews.withColumns({c: e for c, e in derived.items() if c not in order_reviews.columns})
    ids = [F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")) for c in ("review_id", "order_id")]
    return frame.withColumns({"has_text": F.col("has_text").cast("boolean"), "_row": F.concat_ws("|", *ids, "text_digest")})


def _best_first(narrow: DataFrame) -> list[Column]:
    """The order in which ``picked`` looks at the rows of a review."""
    ranked = {"review_id", "order_id", "review_answer_timestamp", "review_score", "has_text", "text_digest", "_row"}
    return [
        F.col("has_text").desc(),
        F.col("review_answer_timestamp").desc_nulls_last(),
        F.col("order_id").asc_nulls_last(),
        F.col("review_score").asc_nulls_first(),
        F.col("text_digest"),
        *[F.col(c).asc_nulls_first() for c in narrow.columns if c not in ranked],
    ]


def picked(order_reviews: DataFrame, clean: DataFrame, keep_digest: bool = False) -> DataFrame:
    """The richest row per review among its delivered orders, without its text; ``_row`` finds the text.

    Text first, then the newest answer, then the smallest order id; score, text digest and the
    remaining columns settle what is still tied, so the pick does not depend on partitioning. Flag
    and digest are taken at the scan. The ``rn = 1`` filter makes Spark keep one row per review and
    map task before the shuffle, so a review id that holds a large part of the rows costs its
    reducer one row per map task.
    """
    narrow = with_derived(order_reviews).drop(*TEXT_COLUMNS)
    delivered = narrow.join(clean.select("order_id"), "order_id", "left_semi")
    best_first = Window.partitionBy("review_id").orderBy(*_best_first(narrow))
    return delivered.withColumn("rn", F.row_number().over(best_first)).filter("rn = 1").drop("rn", *(() if keep_digest else ("text_digest",)))


def picked_with_orders(order_reviews: DataFrame, clean: DataFrame) -> DataFrame:
    """``picked``, without its row key, joined with ``clean``; the orders are read and joined once for both.

    Only the best row of a review and order can be picked. It meets its order before the pick, where both
    lie by order id. An order that is there twice repeats the row, and the pick keeps all copies of the best.
    """
    narrow = with_derived(order_reviews).drop(*TEXT_COLUMNS, "_row")
    best_first = _best_first(narrow)
    of_order = Window.partitionBy("order_id", "review_id").orderBy(*best_first)
    one = narrow.withColumn("rn", F.row_number().over(of_order)).filter("rn = 1")
    # What comes after the order id settles nothing between rows of different orders.
    of_review = Window.partitionBy("review_id").orderBy(*best_first[:3])
    return one.join(clean, "order_id").withColumn("rn", F.rank().over(of_review)).filter("rn = 1").drop("rn", "text_digest")


def one_text_per_row(texts: DataFrame) -> DataFrame:
    """(_row, texts) with one row per ``_row``. Rows of one key have the same text; all but one go before the shuffle already."""
    one = Window.partitionBy("_row").orderBy("_row")
    return texts.select("_row", *TEXT_COLUMNS).withColumn("rn", F.row_number().over(one)).filter("rn = 1").drop("rn")


def with_text(narrow: DataFrame, order_reviews: DataFrame) -> DataFrame:
    """Adds ``TEXT_COLUMNS`` to rows with a ``_row`` key: the only shuffle of the text."""
    return narrow.join(one_text_per_row(with_derived(order_reviews)), "_row").drop("_row")


def deduplicated(order_reviews: DataFrame, clean: DataFrame) -> DataFrame:
    """One row per review with its text and its ``has_text`` flag."""
    return with_text(picked(order_reviews, clean), order_reviews).select(*source_columns(order_reviews), "has_text")


def reviews_dedup(order_reviews: DataFrame, clean: DataFrame) -> DataFrame:
    """``deduplicated`` with the columns of the source table."""
    return deduplicated(order_reviews, clean).drop("has_text")


def order_items_agg(order_items: DataFrame) -> DataFrame:
    """Items at order grain.

    The sellers of an order are a set that is merged like the sums, so items are added up where they are
    read and shuffled once; a distinct count would shuffle every item by order and seller first.
    """
    return order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.size(F.collect_set("seller_id")).cast("long").alias("n_sellers"),
        money_sum(F.col("price")).alias("items_total"),
        money_sum(F.col("freight_value")).alias("freight_total"),
    )


def order_payments_agg(order_payments: DataFrame) -> DataFrame:
    """Payments at order grain."""
    return order_payments.groupBy("order_id").agg(
        money_sum(F.col("payment_value")).alias("payment_total"),
        F.count(F.lit(1)).alias("n_payments"),
        F.max("payment_installments").alias("max_installments"),
    )


def _point_sums(geolocation: DataFrame, *keys: str) -> DataFrame:
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    return geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip_prefix"), *keys).agg(
        exact_sum(lat).alias("lat"),
        F.count(lat).alias("n_lat"),
        exact_sum(lng).alias("lng"),
        F.count(lng).alias("n_lng"),
    )


def zip_points(geolocation: DataFrame) -> DataFrame:
    """One point per zip prefix."""
    return _point_sums(geolocation).select(
        "zip_prefix",
        mean_of(F.col("lat"), F.col("n_lat")).alias("lat"),
        mean_of(F.col("lng"), F.col("n_lng")).alias("lng"),
    )


def geolocation_centroid(geolocation: DataFrame) -> DataFrame:
    """One point per zip prefix; the largest state name represents the prefix.

    A maximum of strings cannot be kept in a hash aggregation, and the raw points should not be
    sorted for it: points are added up per prefix and state, the few results per prefix.
    """
    return (
        _point_sums(geolocation, "geolocation_state")
        .groupBy("zip_prefix")
        .agg(
            mean_of(F.sum("lat"), F.sum("n_lat")).alias("lat"),
            mean_of(F.sum("lng"), F.sum("n_lng")).alias("lng"),
            F.max("geolocation_state").alias("geo_state"),
        )
    )
