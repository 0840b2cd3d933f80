import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from punctual.operators import gold as gold_ops
from punctual.operators import profile, silver
from punctual.plans import medallion
from punctual.sources.bronze import Bronze

D = dt.datetime

ORDERS = (
    "order_id string, customer_id string, order_status string, "
    "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
    "order_estimated_delivery_date timestamp_ntz"
)
REVIEWS = (
    "review_id string, order_id string, review_score int, review_comment_title string, "
    "review_comment_message string, review_answer_timestamp timestamp_ntz"
)


def order(order_id, customer="c1", delivered=D(2018, 1, 5), estimated=D(2018, 1, 10), status="delivered"):
    return (order_id, customer, status, D(2018, 1, 1), delivered, estimated)


def review(review_id, order_id, text=None, answered=D(2018, 2, 1), score=3, title=None):
    return (review_id, order_id, score, title, text, answered)


def make_bronze(spark, orders, reviews, items=(), payments=(), customers=None, points=()):
    if customers is None:
        customers = [("c1", "u1", "SP", "01037", "sao paulo")]
    return Bronze(
        orders=spark.createDataFrame(list(orders), ORDERS),
        order_reviews=spark.createDataFrame(list(reviews), REVIEWS),
        order_items=spark.createDataFrame(
            list(items), "order_id string, seller_id string, price double, freight_value double"
        ),
        order_payments=spark.createDataFrame(
            list(payments), "order_id string, payment_value double, payment_installments int"
        ),
        customers=spark.createDataFrame(
            list(customers),
            "customer_id string, customer_unique_id string, customer_state string, "
            "customer_zip_code_prefix string, customer_city string",
        ),
        geolocation=spark.createDataFrame(
            list(points),
            "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, "
            "geolocation_state string",
        ),
    )


def dedup_rows(spark, orders, reviews, partitions=None):
    bronze = make_bronze(spark, orders, reviews)
    source = bronze.order_reviews
    if partitions:
        source = source.repartition(partitions)
    return silver.reviews_dedup(source, silver.orders_clean(bronze.orders)).collect()


def test_missing_delivery_date_excludes_whatever_the_status(spark):
    orders = [order("a"), order("b", delivered=None), order("c", status="canceled")]
    kept = silver.orders_clean(make_bronze(spark, orders, []).orders)
    assert sorted(r.order_id for r in kept.collect()) == ["a", "c"]


@pytest.mark.parametrize(
    "candidates, winner",
    [
        # text beats a newer answer
        ([review("r", "o1", None, D(2018, 3, 1)), review("r", "o2", "x", D(2018, 1, 1))], "o2"),
        # a blank is text
        ([review("r", "o1", None, D(2018, 3, 1)), review("r", "o2", " ", D(2018, 1, 1))], "o2"),
        # newest answer, missing answers last
        ([review("r", "o1", "x", D(2018, 1, 1)), review("r", "o2", "x", D(2018, 1, 2))], "o2"),
        ([review("r", "o1", "x", None), review("r", "o2", "x", D(2018, 1, 2))], "o2"),
        # smallest order id
        ([review("r", "o2", "x"), review("r", "o1", "x")], "o1"),
        # the better row sits on an undelivered order
        ([review("r", "gone", "x", D(2019, 1, 1)), review("r", "o2", None)], "o2"),
    ],
)
def test_richest_review_wins(spark, candidates, winner):
    orders = [order("o1"), order("o2"), order("gone", delivered=None)]
    rows = dedup_rows(spark, orders, candidates)
    assert [(r.review_id, r.order_id) for r in rows] == [("r", winner)]


def test_exact_duplicates_and_full_ties_are_settled_the_same_way_everywhere(spark):
    rows = [
        review("r", "o1", "x", score=1),
        review("r", "o1", "x", score=5, title="t"),
        review("r", "o1", "x", score=5, title="t"),
        review("s", "o1", "x"),
        review("s", "o1", "x"),
    ]
    picks = {
        tuple(sorted(tuple(map(str, r)) for r in dedup_rows(spark, [order("o1")], rows[i:] + rows[:i], n)))
        for i, n in [(0, 1), (1, 2), (3, 5)]
    }
    assert len(picks) == 1 and len(next(iter(picks))) == 2


def test_ties_that_differ_only_in_which_text_is_missing_are_settled(spark):
    source = make_bronze(spark, [order("o1")], [review("r", "o1", "x")]).order_reviews
    rows = source.withColumn("extra", F.lit("e")).withColumn("review_comment_title", F.lit(None).cast("string"))
    other = source.withColumn("extra", F.lit(None).cast("string")).withColumn("review_comment_title", F.lit("e"))
    clean = silver.orders_clean(make_bronze(spark, [order("o1")], []).orders)
    picks = {
        silver.reviews_dedup(frame, clean).first()
        for frame in (rows.union(other).coalesce(1), other.union(rows).coalesce(1))
    }
    assert len(picks) == 1


def test_repeated_orders_do_not_repeat_deduplicated_reviews(spark):
    rows = dedup_rows(spark, [order("o1"), order("o1")], [review("r", "o1")])
    assert len(rows) == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_scores_are_those_of_the_features_on_odd_rows(spark, parts):
    """Repeated and missing keys, orders and customers that come twice or not at all, full ties."""
    early, late = D(2018, 1, 5), D(2018, 1, 20)
    orders = [order("o1"), order("o1", delivered=late), order("o1", "c2"), order("o2", "nobody"), order("o3", delivered=None), order("o4", None), order("o5", "c2", early, None), order(None), order("o6", "c2", late), order("o6", "c2", late)]
    reviews = [
        *[review("r1", "o1", "x", score=4)] * 3,
        review("r1", "o2", "a", D(2018, 1, 1)),
        *[review("r2", "o2", "x"), review("r2", "o1")],
        *[review("r3", "o3", "x"), review("r3", "o6", score=None), review("r3", "o6", score=2)],
        *[review(None, "o5", "x", None, 1), review(None, "o6", "x", None, 5), review(None, "o6")],
        *[review("r4", "o4"), review("r5", None), review("r6", "o9"), review("r7", "o5", score=None)],
        *[review("r8", "o6", "b", score=1), review("r8", "o6", "a", score=1), review("r8", "o5", "a", D(2018, 3, 1), 5)],
    ]
    customers = [("c1", "u1", "SP", "01037", "sao paulo"), ("c2", "u2", "SP", None, "x"), ("c2", "u3", "RJ", "01037", "y"), (None, "u4", "SP", "1", "z")]
    bronze = make_bronze(spark, orders, reviews, [("o1", "s1", 1.0, 1.0)] * 2, [("o1", 1.0, 1)] * 2, customers, [("01037", 1.0, 1.0, "SP")] * 2)
    bronze = replace(bronze, order_reviews=bronze.order_reviews.repartition(parts), orders=bronze.orders.repartition(parts))
    scores = medallion.build_scores(bronze)
    assert scores.columns == ["review_id", "is_late", "review_score"]
    told = sorted(map(repr, scores.collect()))
    assert told == sorted(map(repr, medallion.build_features(bronze).select(*scores.columns).collect()))
    assert sum("'r1'" in r for r in told) == 4 and sum("review_id=None" in r for r in told) == 2 and not any("'r2'" in r for r in told)


def test_copies_of_a_review_do_not_meet_every_copy_of_their_order(spark):
    """Rows made by the join with the orders: one per copy of the order, not one per pair of copies."""
    bronze = make_bronze(spark, [order("o1")] * 30, [review("r1", "o1", "x")] * 40)
    clean = silver.orders_clean(bronze.orders).select("order_id", "customer_id")
    seen = silver.picked_with_orders(bronze.order_reviews.withColumn("extra", F.lit(1)), clean)
    assert seen.count() == 30
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "row_number()" in plan[plan.index("Join Inner") :]


def test_gold_has_review_grain_and_keeps_left_join_misses(spark):
    bronze = make_bronze(
        spark,
        [order("o1"), order("o2"), order("o3", customer="nobody"), order("o4", delivered=None)],
        [review("r1", "o1", "x"), review("r2", "o2"), review("r3", "o3"), review("r4", "o4")],
        items=[("o1", "s1", 10.1, 1.0), ("o1", "s1", 0.2, 2.0), ("o1", "s2", 5.0, 0.5)],
        payments=[("o1", 7.3, 1), ("o1", 11.0, 4)],
        points=[("01037", -23.5, -46.5, "SP"), ("01037", -23.7, -46.7, "RJ")],
    )
    gold = medallion.build_gold(bronze)
    assert gold.columns == list(gold_ops.GOLD_COLUMNS)
    rows = {r.review_id: r for r in gold.collect()}
    assert set(rows) == {"r1", "r2"}
    full, bare = rows["r1"], rows["r2"]
    assert (full.n_items, full.n_sellers, full.items_total, full.freight_total) == (3, 2, 15.3, 3.5)
    assert (full.payment_total, full.max_installments) == (18.3, 4)
    assert full.has_text and not bare.has_text
    assert (full.customer_lat, full.customer_lng) == pytest.approx((-23.6, -46.6))
    assert bare.n_items is None and bare.payment_total is None
    assert gold_ops.grain_check(gold).first().asDict() == {
        "n_rows": 2,
        "n_review_ids": 2,
        "is_unique": True,
    }


def test_stored_silver_gives_the_same_gold(spark, tmp_path):
    bronze = make_bronze(
        spark,
        [order("o1"), order("o2", estimated=D(2018, 1, 2))],
        [review("r1", "o1", "x"), review("r2", "o2")],
        items=[("o1", "s1", 1.0, 1.0)],
    )
    stages = medallion.stage(bronze, str(tmp_path))
    lazy = medallion.build_features(bronze).orderBy("review_id").collect()
    assert stages.features.orderBy("review_id").collect() == lazy
    assert stages.silver.reviews_dedup.columns == bronze.order_reviews.columns


def test_grain_check_sees_a_repeated_id(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "review_id string")
    assert gold_ops.grain_check(frame).first().asDict() == {
        "n_rows": 3,
        "n_review_ids": 2,
        "is_unique": False,
    }


def test_centroid_state_is_the_largest_name_and_missing_points_are_skipped(spark):
    points = [("1", 1.0, None, "B"), ("1", 3.0, 5.0, "A"), (None, 1.0, 1.0, "C")]
    frame = make_bronze(spark, [], [], points=points).geolocation
    rows = {r.zip_prefix: (r.lat, r.lng, r.geo_state) for r in silver.geolocation_centroid(frame).collect()}
    assert rows["1"] == (2.0, 5.0, "B")


def test_null_zip_meets_no_centroid(spark):
    bronze = make_bronze(
        spark,
        [order("o1")],
        [review("r1", "o1")],
        customers=[("c1", "u1", "SP", None, "x")],
        points=[(None, 1.0, 1.0, "C")],
    )
    assert medallion.build_gold(bronze).first().customer_lat is None


def test_profiles(spark):
    bronze = make_bronze(
        spark,
        [order("a"), order("b", delivered=None, status="shipped"), order("c", customer="c2")],
        [review("r", "a", "x"), review("r", "b"), review("s", "c")],
        customers=[("c1", "u1", "", "", ""), ("c2", "u2", "", "", "")],
    )
    assert tuple(profile.review_key_profile(bronze.order_reviews).first()) == (3, 2, 1)
    assert [tuple(r) for r in profile.excluded_by_status(bronze.orders).collect()] == [("shipped", 1)]
    assert tuple(profile.one_time_buyers(bronze.orders, bronze.customers).first()) == (2, 50.0)


def test_single_statement_equals_the_builders(spark):
    bronze = make_bronze(
        spark,
        [order("o1"), order("o2"), order("o3", delivered=None)],
        [review("r1", "o1", "x"), review("r1", "o2", "y"), review("r2", "o3", "z"), review("r3", "o2")],
        items=[("o1", "s1", 1.5, 1.0)],
        points=[("01037", 1.0, 2.0, "SP")],
    )
    statement = medallion.gold_by_statement(spark, bronze.create_views("t_")).withColumn(
        "has_text", F.col("has_text").cast("boolean")
    )
    key = "review_id"
    assert statement.orderBy(key).collect() == medallion.build_gold(bronze).orderBy(key).collect()


def test_money_sums_are_exact_for_any_size_and_order(spark):
    from decimal import Decimal

    from punctual.functions.numeric import money_sum

    groups = {
        "tenths": [0.1] * 3 + [0.2] * 7,
        "beyond_exact_doubles": [99999999999.99] * 1001,
        "refunds": [-12.34, 0.05, -99999.99],
        "missing": [None, 1.1],
        "large_with_six_decimals": [1234567890.123456, -2000000000.654321, 999999999.999999],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.s for r in frame.groupBy("k").agg(money_sum(F.col("v")).alias("s")).collect()}
    assert got == {
        k: float(sum(Decimal(str(v)) for v in values if v is not None)) for k, values in groups.items()
    }
    assert frame.filter("v IS NULL").agg(money_sum(F.col("v")).alias("s")).first().s is None


def test_money_keeps_more_than_two_decimals(spark):
    frame = spark.createDataFrame([("o1", 1, 0.004, 0.0)] * 10, "order_id string, seller_id int, price double, freight_value double")
    assert silver.order_items_agg(frame).first().items_total == 0.04


def test_both_forms_of_gold_settle_full_ties_alike(spark):
    rows = [review("r", "o1", "x", score=s, title=t) for s, t in ((2, "b"), (1, "z"), (2, None), (1, "a"))]
    bronze = make_bronze(spark, [order("o1")], rows)
    lazy = medallion.build_gold(bronze).first()
    views = medallion.create_views(bronze, "tie_")
    stated = medallion.gold_by_statement(spark, views).first()
    named = spark.table("tie_gold_reviews").first()
    assert lazy.review_score == stated.review_score == named.review_score == 1
    assert lazy.review_comment_title == stated.review_comment_title == named.review_comment_title


def test_views_of_all_layers_are_registered(spark):
    names = medallion.create_views(make_bronze(spark, [order("o1")], [review("r", "o1", "x")]), "all_")
    assert len(names) == 12
    for view in names.values():
        assert spark.sql(f"SELECT count(*) AS n FROM {view}").first().n >= 0


def test_one_time_buyers_of_nobody(spark):
    from punctual.operators import profile

    orders = spark.createDataFrame([], "order_id string, customer_id string")
    customers = spark.createDataFrame([], "customer_id string, customer_unique_id string")
    assert tuple(profile.one_time_buyers(orders, customers).first()) == (0, None)


def _texts_moved(frame):
    """The exchanges of the whole plan whose rows carry the message, and their other columns."""
    plan = frame._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            output = node.output()
            names = {output.apply(i).name() for i in range(output.size())}
            found.extend([names] if "review_comment_message" in names else [])
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


def test_the_statement_moves_texts_last_and_once(spark):
    reviews = [review("r1", "o1", "x"), review("r1", "o1", "x", score=1), review(None, "o2", "y"), review("r3", "o2", title="t"), review("r4", None, "z"), review("r5", "o9", "z")]
    bronze = make_bronze(
        spark,
        [order("o1"), order("o2"), order("o3", delivered=None)],
        reviews,
        items=[("o1", "s1", 1.5, 1.0), ("o1", "s1", 1.5, 1.0), ("o1", None, 2.0, 1.0), ("o3", "s1", 1.0, 1.0)],
    )
    statement = medallion.gold_by_statement(spark, bronze.create_views("once_"))
    assert len(_texts_moved(statement)) == 1
    got = statement.withColumn("has_text", F.col("has_text").cast("boolean"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, medallion.build_gold(bronze).collect()))
    derived = silver.with_derived(bronze.order_reviews).drop("_row")
    derived.createOrReplaceTempView("once_order_reviews")
    views = {name: f"once_{name}" for name in bronze.tables()}
    again = medallion.gold_by_statement(spark, views)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, statement.collect()))
