"""Hot keys, partitioning independence and the shape of the plans."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from punctual.catalogue import stand_ins
from punctual.catalogue.queries import queries
from punctual.operators import features as feature_ops
from punctual.operators import gold as gold_ops
from punctual.operators import profile, regional, silver
from punctual.plans import medallion
from punctual.session import RUNTIME_SETTINGS, tune
from punctual.sources.bronze import Bronze
from punctual.sources.star_schema import star_schema_bronze

N = 6000
FOLDER = "/root/testdata/sf0.001"


def hot(column, value, of_three=0):
    """A third of the rows get ``value``, the others their own id."""
    return F.when(F.col("id") % 3 == of_three, F.lit(value)).otherwise(column)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the reviews share an id, another third an order; hot customer, zip and city."""
    tune(spark)
    ids = spark.range(N)
    name = F.col("id").cast("string")
    day = F.lit(dt.datetime(2018, 1, 1)).cast("timestamp_ntz")
    return Bronze(
        orders=ids.select(
            F.concat(F.lit("o"), name).alias("order_id"),
            hot(F.concat(F.lit("c"), name), "c0").alias("customer_id"),
            F.lit("delivered").alias("order_status"),
            day.alias("order_purchase_timestamp"),
            F.when(F.col("id") % 10 != 9, day + F.expr("make_dt_interval(cast(id % 40 as int))")).alias(
                "order_delivered_customer_date"
            ),
            (day + F.expr("interval 20 days")).alias("order_estimated_delivery_date"),
        ),
        order_reviews=ids.select(
            hot(F.concat(F.lit("r"), name), "r0", 0).alias("review_id"),
            hot(F.concat(F.lit("o"), name), "o1", 1).alias("order_id"),
            (F.col("id") % 5 + 1).cast("int").alias("review_score"),
            F.lit("title").alias("review_comment_title"),
            F.when(F.col("id") % 2 == 0, F.concat(F.lit("bom texto "), name)).alias("review_comment_message"),
            (day + F.expr("make_dt_interval(cast(id % 7 as int))")).alias("review_answer_timestamp"),
        ),
        order_items=ids.select(
            hot(F.concat(F.lit("o"), name), "o1").alias("order_id"),
            (F.col("id") % 50).alias("seller_id"),
            (F.col("id") / 100).alias("price"),
            F.lit(0.1).alias("freight_value"),
        ),
        order_payments=ids.select(
            hot(F.concat(F.lit("o"), name), "o1").alias("order_id"),
            (F.col("id") / 100).alias("payment_value"),
            (F.col("id") % 12).cast("int").alias("payment_installments"),
        ),
        customers=ids.select(
            F.concat(F.lit("c"), name).alias("customer_id"),
            hot(F.concat(F.lit("u"), name), "u0").alias("customer_unique_id"),
            F.lit("SP").alias("customer_state"),
            hot(name, "0").alias("customer_zip_code_prefix"),
            hot(F.concat(F.lit("city"), F.col("id") % 100), "hot").alias("customer_city"),
        ),
        geolocation=ids.select(
            hot(name, "0").alias("geolocation_zip_code_prefix"),
            (F.col("id") / 1000).alias("geolocation_lat"),
            (F.col("id") / -1000).alias("geolocation_lng"),
            F.lit("SP").alias("geolocation_state"),
        ),
    )


@pytest.fixture(scope="module")
def expected_gold(skewed):
    """The same tables taken to gold by plain Python."""
    rows = {name: frame.collect() for name, frame in skewed.tables().items()}
    delivered = {r.order_id: r for r in rows["orders"] if r.order_delivered_customer_date}
    best = {}
    for r in rows["order_reviews"]:
        if r.order_id in delivered:
            rank = (r.review_comment_message is None, -r.review_answer_timestamp.toordinal(), r.order_id)
            if r.review_id not in best or rank < best[r.review_id][0]:
                best[r.review_id] = (rank, r)
    customers = {r.customer_id: r for r in rows["customers"]}
    items, points = {}, {}
    for r in rows["order_items"]:
        n, sellers, total = items.get(r.order_id, (0, set(), 0))
        items[r.order_id] = (n + 1, sellers | {r.seller_id}, total + round(r.price * 100))
    for r in rows["geolocation"]:
        n, total = points.get(r.geolocation_zip_code_prefix, (0, 0))
        points[r.geolocation_zip_code_prefix] = (n + 1, total + round(r.geolocation_lat * 1000))
    gold = {}
    for review_id, (_, r) in best.items():
        customer = customers[delivered[r.order_id].customer_id]
        n, sellers, total = items.get(r.order_id, (None, None, None))
        count, lat = points[customer.customer_zip_code_prefix]
        gold[review_id] = (
            r.order_id,
            r.review_comment_message,
            customer.customer_city,
            n,
            len(sellers) if n else None,
            total / 100 if n else None,
            pytest.approx(lat / 1000 / count),
        )
    return gold


def gold_dict(frame):
    return {
        r.review_id: (
            r.order_id,
            r.review_comment_message,
            r.customer_city,
            r.n_items,
            r.n_sellers,
            r.items_total,
            r.customer_lat,
        )
        for r in frame.collect()
    }


def test_hot_keys_keep_every_row(skewed, expected_gold):
    gold = medallion.build_gold(skewed)
    assert gold_dict(gold) == expected_gold
    assert gold_ops.grain_check(gold).first().is_unique


def test_hot_order_and_customer_are_split_at_run_time(spark, skewed, expected_gold):
    """With small thresholds the partitions of a hot order and customer are read by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        # Many small map tasks, as on a cluster: a partition is split between them.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        gold = medallion.build_gold(skewed)
        assert gold_dict(gold) == expected_gold
        plan = gold._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("Initial Plan")]
        assert len(re.findall(r"SortMergeJoin\(skew=true\)", final)) >= 3
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_hot_city_and_hot_customer(skewed, expected_gold):
    features = medallion.build_features(skewed)
    cities = {r.customer_city: r.n for r in regional.city_lateness(features, 1).collect()}
    want = {}
    for row in expected_gold.values():
        want[row[2]] = want.get(row[2], 0) + 1
    assert cities == want
    buyers = {}
    customers = {r.customer_id: r.customer_unique_id for r in skewed.customers.collect()}
    for r in skewed.orders.collect():
        unique = customers[r.customer_id]
        buyers[unique] = buyers.get(unique, 0) + 1
    once = sum(n == 1 for n in buyers.values())
    row = profile.one_time_buyers(skewed.orders, skewed.customers).first()
    assert (row.n_customers, row.one_time_pct) == (len(buyers), round(100 * once / len(buyers), 1))


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_dedup_keeps_one_row_per_review_and_task_before_the_shuffle(skewed):
    clean = silver.orders_clean(skewed.orders)
    plan = _plan(silver.reviews_dedup(skewed.order_reviews, clean))
    final, partial = plan.index("row_number(), 1, Final"), plan.index("row_number(), 1, Partial")
    assert "Exchange hashpartitioning(review_id" in plan[final:partial]


def test_no_plan_holds_a_cross_join(spark):
    stored = ("staged", "csv", "parquet", "cache", "job", "theme", "label", "chart", "analysis", "op", "pipeline")
    for name, query in queries().items():
        if any(word in name for word in stored):
            continue
        plan = _plan(query(spark, FOLDER))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def _shuffled(frame, column):
    """Exchanges of the initial plan, without any broadcast, whose rows carry ``column``."""
    plan = frame._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            output = node.output()
            names = [output.apply(i).name() for i in range(output.size())]
            if column in names:
                found.append(names)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_review_text_is_shuffled_once(spark, no_broadcast, skewed):
    message = "review_comment_message"
    assert len(_shuffled(medallion.build_gold(skewed), message)) == 1
    assert not _shuffled(medallion.build_gold(skewed, text=False), message)


def test_score_query_shuffles_no_text_and_reads_no_basket(spark, no_broadcast):
    frame = profile.score_by_outcome(medallion.build_features(star_schema_bronze(spark, FOLDER), text=False))
    assert "l_extendedprice" not in _plan(frame) and "s_acctbal" not in _plan(frame)
    for column in ("text", "review_comment_message", "review_comment_title"):
        assert not _shuffled(frame, column), column


def test_interval_joins_orders_with_their_lines_once(spark, no_broadcast):
    bronze = star_schema_bronze(spark, FOLDER)
    twice = medallion.build_features(bronze, text=False).select("review_id", "is_late", "review_score")
    once = medallion.build_scores(bronze)
    assert (len(_shuffled(twice, "l_orderkey")), len(_shuffled(once, "l_orderkey"))) == (2, 1)
    assert len(_shuffled(once, "o_orderkey")) == 1
    for column in ("text", "order_estimated_delivery_date"):
        assert not _shuffled(once, column), column


def test_scores_of_hot_keys_are_those_of_the_features(skewed):
    scores = medallion.build_scores(skewed)
    wanted = medallion.build_features(skewed, text=False).select(*scores.columns)
    assert scores.exceptAll(wanted).isEmpty() and wanted.exceptAll(scores).isEmpty()


def test_sampled_ids_are_picked_without_text(spark, no_broadcast, skewed):
    from punctual.operators.sampling import sample_ranked

    negative = feature_ops.negative_text_reviews(medallion.build_features(skewed, text=True))
    assert not _shuffled(sample_ranked(negative.select("review_id"), "review_id", 50, 42), "review_comment_message")


def test_delivery_filter_and_columns_reach_the_parquet_scan(spark, tmp_path, skewed):
    skewed.orders.write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    plan = _plan(silver.orders_clean(orders).select("order_id"))
    assert "PushedFilters: [IsNotNull(order_delivered_customer_date)]" in plan
    assert "ReadSchema: struct<order_id:string,order_delivered_customer_date:timestamp_ntz>" in plan


def test_data_driven_histogram_gathers_no_gaps(spark):
    """All gaps distinct: what is shuffled is bins, and one row per task for the bounds."""
    from punctual.operators.distributions import gap_histogram_equal_width

    gaps = spark.range(0, 50_000, 1, 8).select(
        (F.col("id") * 90.0 / 49_999 - 30).alias("delivery_gap_days"),
        F.when(F.col("id") % 2 == 0, "Late").otherwise("On-time").alias("delivery_outcome"),
    )
    frame = gap_histogram_equal_width(gaps)
    rows = frame.collect()
    assert len(rows) == 120 and sum(r.n for r in rows) == 50_000
    assert {r.n for r in rows} <= {416, 417, 418}
    assert "hashpartitioning(gap" not in _plan(frame)


@pytest.mark.parametrize("name", ["review_features", "sentiment_labels", "negative_sample", "theme_frequency"])
def test_results_do_not_depend_on_partitioning(spark, name, skewed):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    runs = []
    for n in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(queries()[name](spark, FOLDER).collect(), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert runs[0] == runs[1]


def test_runtime_settings_are_applied(spark):
    tune(spark)
    assert all(spark.conf.get(key) == value for key, value in RUNTIME_SETTINGS.items())


def test_negative_text_population(spark, skewed):
    features = medallion.build_features(skewed)
    rows = feature_ops.negative_text_reviews(features).collect()
    picked = {r.review_id for r in features.collect() if r.review_score <= 2 and r.review_comment_message}
    assert {r.review_id for r in rows} == picked
    assert stand_ins.rule_labels(
        skewed.order_reviews.withColumn("review_id", F.regexp_extract("review_id", r"(\d+)", 1).cast("long"))
    ).count() >= len(picked)


def test_items_are_shuffled_once_by_order(spark):
    """One exchange with one row per order and task, not one of every item by order and seller."""
    items = star_schema_bronze(spark, FOLDER).order_items
    plan = _plan(silver.order_items_agg(items))
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(order_id" in plan.replace("l_orderkey", "order_id")
    odd = spark.createDataFrame([(1, 5, 1.0, 0.5), (1, 5, 2.0, 0.5), (1, None, 3.0, 0.5), (2, None, 4.0, 0.5), (None, 6, 1.0, 0.5)], "order_id long, seller_id long, price double, freight_value double")
    assert {r.order_id: (r.n_items, r.n_sellers) for r in silver.order_items_agg(odd).collect()} == {1: (3, 1), 2: (1, 0), None: (1, 1)}


def test_words_are_not_shuffled_to_meet_the_stand_in_lexicon(spark):
    from punctual.operators.sentiment import with_lexicon_compound

    texts = spark.createDataFrame([(1, "good and hate"), (2, None)], "review_id long, text string")
    scored = with_lexicon_compound(texts, "text", stand_ins.lexicon(spark))
    plan = _plan(scored)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(token" not in plan
    assert {(r.token, r.valence) for r in stand_ins.lexicon(spark).collect()} == set(stand_ins.LEXICON)
    assert scored.count() == 2


def test_texts_are_stored_once_for_gold_and_features(spark, tmp_path, skewed, expected_gold):
    import os

    stages = medallion.stage(skewed, str(tmp_path / "stages"))
    assert sorted(os.listdir(tmp_path / "stages")) == ["features", "geolocation_centroid", "order_items_agg", "order_payments_agg", "orders_clean", "reviews_dedup"]
    assert stages.gold.columns == list(medallion.GOLD_COLUMNS) and gold_dict(stages.gold) == expected_gold
    written = os.listdir(tmp_path / "stages" / "features")
    assert any(name.endswith(".zstd.parquet") for name in written)


def test_python_batches_are_bounded(spark):
    """Rows and bytes that a Python worker holds at once, whatever the size of the table."""
    tune(spark)
    seen = spark.range(0, 9000, 1, 1).mapInArrow(lambda batches: batches, "id long")
    assert seen.count() == 9000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 1 << 24
