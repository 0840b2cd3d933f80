"""The six source tables expressed over a TPC-H-like star schema with events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.operators.silver import TEXT_DIGEST
from punctual.sources.bronze import Bronze

# Declared schemas: no job reads file footers while a plan is being built.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_shipdate timestamp_ntz"
    ),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, event_type string",
    "documents": "doc_id bigint, text string, source string",
}

# Event type -> review score; every other type scores 5.
EVENT_SCORES = {"error": 1, "signup": 2, "view": 3, "click": 4}
ESTIMATE_DAYS = 1800


def _orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    shipped = lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_shipped"))
    return orders.join(shipped, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "o_orderstatus AS order_status",
        "o_orderdate AS order_purchase_timestamp",
        "last_shipped AS order_delivered_customer_date",
        f"o_orderdate + INTERVAL '{ESTIMATE_DAYS}' DAY AS order_estimated_delivery_date",
    )


def _order_reviews(events: DataFrame, documents: DataFrame) -> DataFrame:
    scores = " ".join(f"WHEN '{name}' THEN {score}" for name, score in EVENT_SCORES.items())
    # Flag and digest are taken where the text is stored: who reads only them moves no text.
    texts = documents.selectExpr(
        "doc_id",
        "source AS review_comment_title",
        "text AS review_comment_message",
    ).withColumns({"has_text": F.col("review_comment_message").isNotNull(), "text_digest": F.expr(TEXT_DIGEST)})
    return events.join(texts, F.expr("event_id = doc_id"), "left").selectExpr(
        "CASE WHEN event_id % 100 = 99 THEN event_id - 1 ELSE event_id END AS review_id",
        "event_id AS order_id",
        f"CASE event_type {scores} ELSE 5 END AS review_score",
        "review_comment_title",
        "review_comment_message",
        "CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) AS review_answer_timestamp",
        "coalesce(has_text, false) AS has_text",
        "coalesce(text_digest, md5('0|0')) AS text_digest",
    )


def star_schema_bronze(spark: SparkSession, folder: str) -> Bronze:
    """Map ``folder/*.parquet`` onto the source tables; every expression is lazy."""

    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    lineitem = table("lineitem")
    nation = table("nation")
    return Bronze(
        orders=_orders(table("orders"), lineitem),
        order_reviews=_order_reviews(table("events"), table("documents")),
        order_items=lineitem.selectExpr(
            "l_orderkey AS order_id",
            "l_linenumber AS order_item_id",
            "l_suppkey AS seller_id",
            "l_extendedprice AS price",
            "l_quantity AS freight_value",
        ),
        order_payments=lineitem.selectExpr(
            "l_orderkey AS order_id",
            "l_extendedprice AS payment_value",
            "l_linenumber AS payment_installments",
        ),
        customers=table("customer")
        .join(nation, F.expr("c_nationkey = n_nationkey"))
        .join(table("region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "c_custkey AS customer_id",
            "c_name AS customer_unique_id",
            "r_name AS customer_state",
            "c_nationkey AS customer_zip_code_prefix",
            "concat(n_name, '-', c_mktsegment) AS customer_city",
        ),
        geolocation=table("supplier")
        .join(nation, F.expr("s_nationkey = n_nationkey"))
        .selectExpr(
            "s_nationkey AS geolocation_zip_code_prefix",
            "s_acctbal / 1000 AS geolocation_lat",
            "CAST(s_suppkey AS DOUBLE) / 10 AS geolocation_lng",
            "n_name AS geolocation_state",
        ),
    )
