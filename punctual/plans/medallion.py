"""Bronze to silver to gold to features, lazily or staged as Parquet."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import delivery
from punctual.operators import silver
from punctual.operators.features import add_features
from punctual.operators.gold import GOLD_COLUMNS, gold_reviews
from punctual.sources.bronze import Bronze, Sources
from punctual.sources.cache import materialize


@dataclass(frozen=True)
class Silver:
    """The cleaned tables."""

    orders_clean: DataFrame
    reviews_dedup: DataFrame
    order_items_agg: DataFrame
    order_payments_agg: DataFrame
    geolocation_centroid: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def build_silver(bronze: Bronze) -> Silver:
    clean = silver.orders_clean(bronze.orders)
    return Silver(
        orders_clean=clean,
        reviews_dedup=silver.reviews_dedup(bronze.order_reviews, clean),
        order_items_agg=silver.order_items_agg(bronze.order_items),
        order_payments_agg=silver.order_payments_agg(bronze.order_payments),
        geolocation_centroid=silver.geolocation_centroid(bronze.geolocation),
    )


def gold_from_silver(tables: Silver, customers: DataFrame) -> DataFrame:
    return gold_reviews(
        tables.reviews_dedup,
        tables.orders_clean,
        customers,
        tables.order_items_agg,
        tables.order_payments_agg,
        tables.geolocation_centroid,
    )


def build_gold(bronze: Bronze, text: bool = True) -> DataFrame:
    """Gold as one lazy plan; without ``text`` no title or message is shuffled or returned.

    The text joins last, on the narrow rows that are left, and is shuffled once.
    """
    clean = silver.orders_clean(bronze.orders)
    gold = gold_reviews(
        silver.picked(bronze.order_reviews, clean),
        clean,
        bronze.customers,
        silver.order_items_agg(bronze.order_items),
        silver.order_payments_agg(bronze.order_payments),
        silver.zip_points(bronze.geolocation),
    )
    if not text:
        return gold.drop("_row")
    return silver.with_text(gold, bronze.order_reviews).select(*GOLD_COLUMNS)


def load_gold(spark: SparkSession, sources: Sources) -> DataFrame:
    """Gold straight from a source prefix."""
    return build_gold(sources.bronze(spark))


def build_features(bronze: Bronze, text: bool = True) -> DataFrame:
    return add_features(build_gold(bronze, text))


def build_scores(bronze: Bronze) -> DataFrame:
    """(review_id, is_late, review_score) of ``build_features``, for a reader of nothing else.

    Lateness is found at the order, so that neither dates nor order ids move with the reviews. Customers
    join last, as an order without one takes its picked review along; baskets, payments and points
    neither drop nor repeat a row.
    """
    gap = delivery.gap_days(F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date"))
    orders = silver.orders_clean(bronze.orders).select("order_id", "customer_id", delivery.is_late(gap).alias("is_late"))
    reviews = silver.picked_with_orders(bronze.order_reviews, orders).select("review_id", "customer_id", "is_late", "review_score")
    return reviews.join(bronze.customers.select("customer_id"), "customer_id").drop("customer_id")


def create_views(bronze: Bronze, prefix: str = "") -> dict[str, str]:
    """Register the source tables, the cleaned tables and ``gold_reviews`` as lazy temp views.

    Returns logical name -> view name; the twelve names can be used side by side in SQL.
    """
    names = bronze.create_views(prefix)
    layers = {**build_silver(bronze).tables(), "gold_reviews": build_gold(bronze)}
    for name, frame in layers.items():
        names[name] = f"{prefix}{name}"
        frame.createOrReplaceTempView(names[name])
    return names


@dataclass(frozen=True)
class Stages:
    """The stored layers, re-read from their files; gold is read from the columns of the features."""

    silver: Silver
    gold: DataFrame
    features: DataFrame


def stage(bronze: Bronze, root: str) -> Stages:
    """Write every layer below ``root`` and build the next one from the files.

    Each layer is computed once however many consumers read it, and a lost executor costs a
    re-read instead of the whole lineage.
    """
    clean = materialize(silver.orders_clean(bronze.orders), f"{root}/orders_clean")
    tables = Silver(
        orders_clean=clean,
        reviews_dedup=materialize(
            silver.reviews_dedup(bronze.order_reviews, clean), f"{root}/reviews_dedup"
        ),
        order_items_agg=materialize(
            silver.order_items_agg(bronze.order_items), f"{root}/order_items_agg"
        ),
        order_payments_agg=materialize(
            silver.order_payments_agg(bronze.order_payments), f"{root}/order_payments_agg"
        ),
        geolocation_centroid=materialize(
            silver.geolocation_centroid(bronze.geolocation), f"{root}/geolocation_centroid"
        ),
    )
    # The features hold every column of gold, so the texts are written once for both.
    gold = gold_from_silver(tables, bronze.customers)
    features = materialize(add_features(gold), f"{root}/features")
    return Stages(silver=tables, gold=features.select(*gold.columns), features=features)


def gold_statement(views: dict[str, str], derived: bool = False) -> str:
    """Gold as one portable SQL statement over registered tables; ``has_text`` is 0 or 1.

    Rows are picked and joined without their texts, which join last: only rows that have one carry it.
    Items are read for delivered orders, so that they lie by order when sellers are counted. With
    ``derived`` the reviews bring ``silver.DERIVED_COLUMNS`` along, and no text is read to pick a row.
    """
    digest = "text_digest" if derived else silver.TEXT_DIGEST
    has_text = "has_text" if derived else "review_comment_message IS NOT NULL"
    row_key = f"concat_ws('|', coalesce(concat('1', review_id), '0'), order_id, {digest})"

    def money(column: str) -> str:
        value, whole = f"CAST({column} AS DOUBLE)", f"rint(CAST({column} AS DOUBLE))"
        written = f"CAST((CAST({value} AS DECIMAL(30,6)) - CAST({whole} AS DECIMAL(30,6))) * 1000000 AS BIGINT)"
        beyond = f"CASE WHEN abs({value}) < 1e9 THEN CAST(rint(({value} - {whole}) * 1000000) AS BIGINT) ELSE {written} END"
        return (
            f"CAST(CAST(sum(CAST({whole} AS BIGINT)) AS DECIMAL(20,0))"
            f" + CAST(sum({beyond}) AS DECIMAL(20,0)) * 0.000001 AS DOUBLE)"
        )

    return f"""
    WITH delivered AS (
        SELECT order_id, customer_id, order_purchase_timestamp,
               order_delivered_customer_date, order_estimated_delivery_date
        FROM {views['orders']}
        WHERE order_delivered_customer_date IS NOT NULL
    ),
    basket AS (
        SELECT order_id, count(*) AS n_items, count(DISTINCT seller_id) AS n_sellers,
               {money('price')} AS items_total,
               {money('freight_value')} AS freight_total
        FROM {views['order_items']} i
        WHERE EXISTS (SELECT 1 FROM delivered d WHERE d.order_id = i.order_id)
        GROUP BY order_id
    ),
    paid AS (
        SELECT order_id,
               {money('payment_value')} AS payment_total,
               max(payment_installments) AS max_installments
        FROM {views['order_payments']}
        GROUP BY order_id
    ),
    point AS (
        SELECT geolocation_zip_code_prefix AS customer_zip_code_prefix,
               CAST(sum(CAST(geolocation_lat AS DECIMAL(25,15))) AS DOUBLE)
                   / count(geolocation_lat) AS customer_lat,
               CAST(sum(CAST(geolocation_lng AS DECIMAL(25,15))) AS DOUBLE)
                   / count(geolocation_lng) AS customer_lng
        FROM {views['geolocation']}
        GROUP BY geolocation_zip_code_prefix
    ),
    place AS (
        SELECT c.customer_id, c.customer_unique_id, c.customer_state, c.customer_zip_code_prefix,
               c.customer_city, point.customer_lat, point.customer_lng
        FROM {views['customers']} c
        LEFT JOIN point ON point.customer_zip_code_prefix = c.customer_zip_code_prefix
    ),
    candidates AS (
        SELECT r.*
        FROM (
            SELECT review_id, order_id, review_score, CASE WHEN {has_text} THEN 1 ELSE 0 END AS has_text,
                   review_answer_timestamp, {digest} AS text_key, {row_key} AS row_key
            FROM {views['order_reviews']}
        ) r
        JOIN (SELECT DISTINCT order_id FROM delivered) d ON d.order_id = r.order_id
    ),
    picked AS (
        SELECT *,
               row_number() OVER (
                   PARTITION BY review_id
                   ORDER BY has_text DESC, review_answer_timestamp DESC NULLS LAST,
                            order_id ASC NULLS LAST, review_score NULLS FIRST, text_key
               ) AS position
        FROM candidates
    ),
    written AS (
        SELECT row_key, review_comment_title, review_comment_message,
               row_number() OVER (PARTITION BY row_key ORDER BY row_key) AS position
        FROM (
            SELECT review_comment_title, review_comment_message, {row_key} AS row_key
            FROM {views['order_reviews']}
            WHERE order_id IS NOT NULL
              AND (review_comment_title IS NOT NULL OR review_comment_message IS NOT NULL)
        ) w
    )
    SELECT p.review_id, p.order_id, p.review_score, t.review_comment_title,
           t.review_comment_message, p.has_text,
           d.order_purchase_timestamp, d.order_delivered_customer_date,
           d.order_estimated_delivery_date, c.customer_unique_id, c.customer_state,
           c.customer_zip_code_prefix, c.customer_city, c.customer_lat, c.customer_lng,
           basket.n_items, basket.n_sellers, basket.items_total, basket.freight_total,
           paid.payment_total, paid.max_installments
    FROM (SELECT * FROM picked WHERE position = 1) p
    JOIN delivered d ON d.order_id = p.order_id
    LEFT JOIN basket ON basket.order_id = p.order_id
    LEFT JOIN paid ON paid.order_id = p.order_id
    JOIN place c ON c.customer_id = d.customer_id
    LEFT JOIN (SELECT * FROM written WHERE position = 1) t ON t.row_key = p.row_key
    """


def gold_by_statement(spark: SparkSession, views: dict[str, str]) -> DataFrame:
    derived = set(silver.DERIVED_COLUMNS) <= set(spark.table(views["order_reviews"]).columns)
    return spark.sql(gold_statement(views, derived))
