"""Every operator as a query over the star-schema tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.catalogue import stand_ins
from punctual.functions import polarity
from punctual.functions.delivery import outcome_rank
from punctual.operators import (
    bootstrap,
    city_identity as identity,
    distributions,
    features as feature_ops,
    gold as gold_ops,
    labelling,
    outliers,
    profile,
    quantiles,
    regional,
    robust_points as robust,
    sampling,
    sentiment as sentiment_ops,
    silver as silver_ops,
    themes as theme_ops,
)
from punctual.plans import jobs, medallion
from punctual.plans.incremental import KEYS, Changes, IncrementalGold, changed_keys
from punctual.plans.report import analyse
from punctual.session import shared_folder, tune
from punctual.sources.bronze import MULTI_LINE, Bronze, Sources, register_frame, table_counts
from punctual.sources.cache import ResultCache, materialize
from punctual.sources.star_schema import star_schema_bronze

Query = Callable[[SparkSession, str], DataFrame]

# City threshold of the registered query: at sf0.01 it both keeps and drops cities.
CITY_MIN_ORDERS = 75

_REGISTRY: dict[str, Query] = {}


def _query(build: Callable[[SparkSession, Bronze], DataFrame]):
    """Register ``build`` under its name; it gets the session and the mapped source tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(tune(spark), star_schema_bronze(spark, folder))

    _REGISTRY[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _stored(spark: SparkSession, name: str) -> str:
    """A folder for stored results of one query of this application."""
    return f"{shared_folder(spark)}/punctual/{spark.sparkContext.applicationId}/{name}"


def _rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Means are compared to six digits: the engines cast doubles to decimals differently."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _labels(bronze: Bronze, run: int = 1) -> DataFrame:
    return stand_ins.rule_labels(bronze.order_reviews, run)


def _stored_texts(spark: SparkSession, bronze: Bronze, name: str) -> DataFrame:
    """The reviews with text, written once for a query that reads them twice."""
    texts = medallion.build_features(bronze).filter("has_text").select(
        "review_id", "review_score", "review_comment_message", "has_text", "is_negative", "is_late"
    )
    return materialize(texts, _stored(spark, name))


def _sentiment(spark: SparkSession, features: DataFrame) -> DataFrame:
    return sentiment_ops.build_sentiment(
        features, stand_ins.star_model(), stand_ins.lexicon(spark)
    )


# Sources and profiles


@_query
def bronze_counts(spark, bronze):
    return table_counts(bronze.tables())


@_query
def silver_counts(spark, bronze):
    return table_counts(medallion.build_silver(bronze).tables())


@_query
def sql_sum(spark, bronze):
    register_frame(spark, bronze.order_payments, "punctual_payments")
    return spark.sql("SELECT sum(payment_installments) AS s FROM punctual_payments")


@_query
def column_sum(spark, bronze):
    return profile.column_sum(bronze.order_payments, "payment_installments")


@_query
def review_key_profile(spark, bronze):
    return profile.review_key_profile(bronze.order_reviews)


@_query
def excluded_status_breakdown(spark, bronze):
    return profile.excluded_by_status(bronze.orders)


# Silver and gold


@_query
def orders_clean(spark, bronze):
    return medallion.build_silver(bronze).orders_clean


@_query
def reviews_dedup(spark, bronze):
    return medallion.build_silver(bronze).reviews_dedup


@_query
def order_items_agg(spark, bronze):
    return medallion.build_silver(bronze).order_items_agg


@_query
def order_payments_agg(spark, bronze):
    return medallion.build_silver(bronze).order_payments_agg


@_query
def geolocation_centroid(spark, bronze):
    return _rounded(medallion.build_silver(bronze).geolocation_centroid, "lat", "lng")


#: Steps of the registered query, which goes them all.
POINT_STEPS = 8


@_query
def zip_points_robust(spark, bronze):
    """The geometric median of every zip prefix's points after a fixed number of steps."""
    root = _stored(spark, "zip_points_robust")
    points = robust.robust_points(materialize(bronze.geolocation, f"{root}/raw"), root, steps=POINT_STEPS, tolerance=-1.0)
    return _rounded(points, "lat", "lng")


@_query
def gold_reviews(spark, bronze):
    return _rounded(medallion.build_gold(bronze), "customer_lat", "customer_lng")


@_query
def gold_single_statement(spark, bronze):
    views = bronze.create_views("punctual_")
    return _rounded(medallion.gold_by_statement(spark, views), "customer_lat", "customer_lng")


@_query
def gold_by_name(spark, bronze):
    """Gold and a cleaned table by their names in SQL."""
    names = medallion.create_views(bronze, "punctual_")
    return spark.sql(f"""
        SELECT g.review_id, g.order_id, g.review_score, g.has_text, g.customer_city, g.n_items,
               p.payment_total, p.n_payments
        FROM {names['gold_reviews']} g LEFT JOIN {names['order_payments_agg']} p ON p.order_id = g.order_id
    """)


@_query
def gold_grain_check(spark, bronze):
    return gold_ops.grain_check(medallion.build_gold(bronze, text=False))


# Features and the quantitative signal


@_query
def review_features(spark, bronze):
    return _rounded(medallion.build_features(bronze), "customer_lat", "customer_lng")


@_query
def features_from_statement(spark, bronze):
    """Features over the 0/1 flag of the portable statement."""
    gold = medallion.gold_by_statement(spark, bronze.create_views("punctual_"))
    return feature_ops.add_features(gold).select(
        "review_id", "has_text", "delivery_gap_days", "is_late", "delivery_outcome", "is_negative"
    )


@_query
def score_by_outcome(spark, bronze):
    return profile.score_by_outcome(medallion.build_features(bronze, text=False))


@_query
def headline_rates(spark, bronze):
    return profile.headline_rates(medallion.build_features(bronze, text=False))


@_query
def one_time_buyers(spark, bronze):
    return profile.one_time_buyers(bronze.orders, bronze.customers)


@_query
def score_share_by_outcome(spark, bronze):
    return distributions.score_share_by_outcome(medallion.build_features(bronze, text=False))


@_query
def gap_histogram_daily(spark, bronze):
    return distributions.gap_histogram_daily(medallion.build_features(bronze, text=False))


@_query
def gap_histogram_equal_width(spark, bronze):
    gaps = medallion.build_features(bronze, text=False).select("delivery_gap_days", "delivery_outcome")
    return distributions.gap_histogram_equal_width(materialize(gaps, _stored(spark, "gap_histogram")))


@_query
def gap_quantiles(spark, bronze):
    """Quartiles of the delivery gap per outcome."""
    gaps = medallion.build_features(bronze, text=False).select("delivery_gap_days", "delivery_outcome")
    return _rounded(quantiles.gap_quantiles(materialize(gaps, _stored(spark, "gap_quantiles"))), "gap_days", digits=8)


@_query
def score_difference_interval(spark, bronze):
    """Mean score of on-time less late reviews with its bootstrap interval."""
    stored = materialize(medallion.build_scores(bronze), _stored(spark, "score_difference"))
    return _rounded(bootstrap.score_difference(stored), "difference", "low", "high")


@_query
def stability_interval(spark, bronze):
    """Share of reviews with one theme in two runs, with its bootstrap interval."""
    runs = [labelling.one_label_per_review(_labels(bronze, run)) for run in (1, 2)]
    both = runs[0].select("review_id", F.col("theme").alias("a")).join(runs[1].select("review_id", F.col("theme").alias("b")), "review_id")
    stored = materialize(both, _stored(spark, "stability_interval"))
    return _rounded(bootstrap.mean_interval(stored, "review_id", F.col("a") == F.col("b")), "mean", "low", "high")


# Sentiment


@_query
def model_sentiment(spark, bronze):
    text = feature_ops.text_reviews(medallion.build_features(bronze))
    scored = sentiment_ops.with_model_stars(text, "review_comment_message", stand_ins.star_model())
    return scored.select(
        "review_id", "star_a", polarity.stars_to_polarity(F.col("star_a")).alias("label_a")
    )


@_query
def lexicon_sentiment(spark, bronze):
    text = feature_ops.text_reviews(medallion.build_features(bronze))
    scored = sentiment_ops.with_lexicon_compound(
        text.drop("review_score"), "review_comment_message", stand_ins.lexicon(spark)
    )
    return scored.withColumn("label_b", polarity.compound_to_polarity(F.col("compound_b")))


@_query
def sentiment_labels(spark, bronze):
    return _sentiment(spark, medallion.build_features(bronze))


@_query
def sentiment_summary(spark, bronze):
    return sentiment_ops.sentiment_summary(_sentiment(spark, medallion.build_features(bronze)))


@_query
def sentiment_disagreements(spark, bronze):
    texts = _stored_texts(spark, bronze, "sentiment_disagreements")
    return sentiment_ops.disagreements(_sentiment(spark, texts), texts)


@_query
def disagreement_examples(spark, bronze):
    texts = _stored_texts(spark, bronze, "disagreement_examples")
    scored = materialize(_sentiment(spark, texts), _stored(spark, "disagreement_examples_scored"))
    return sentiment_ops.disagreement_examples(scored, texts)


# Themes


#: Sizes of the registered samples; the second is about half of the population at sf0.01.
SAMPLE, HALF_SAMPLE = 400, 150


@_query
def negative_sample(spark, bronze):
    return labelling.negative_sample(_stored_texts(spark, bronze, "negative_sample"), SAMPLE)


@_query
def negative_half_sample(spark, bronze):
    return labelling.negative_sample(_stored_texts(spark, bronze, "negative_half_sample"), HALF_SAMPLE)


@_query
def stratified_negative_sample(spark, bronze):
    """Negative reviews with text, sampled in proportion to delivery outcomes."""
    texts = _stored_texts(spark, bronze, "stratified_negative_sample").filter("is_negative")
    late = texts.withColumn("stratum", F.when(F.col("is_late"), "Late").otherwise("On-time"))
    sample = sampling.stratified_sample(late, "review_id", "stratum", HALF_SAMPLE, 42)
    return sample.select("review_id", "stratum", "quota", "rank", "review_comment_message")


@_query
def all_negatives_ranked(spark, bronze):
    """The whole negative population in sampling order, without a global sort."""
    texts = _stored_texts(spark, bronze, "all_negatives_ranked")
    return labelling.negative_sample(texts).select("review_id", "rank")


@_query
def theme_batches(spark, bronze):
    """Every negative review with its whole text, in batches, from stored features."""
    features = materialize(medallion.build_features(bronze), _stored(spark, "theme_batches"))
    return labelling.review_blocks(labelling.negative_sample(features)).drop("review_ids")


@_query
def theme_batches_whole_text(spark, bronze):
    """The same from stored texts."""
    texts = _stored_texts(spark, bronze, "theme_batches_whole_text")
    return labelling.review_blocks(labelling.negative_sample(texts)).drop("review_ids")


@_query
def theme_batches_short(spark, bronze):
    """The same of a sample, with texts cut by request."""
    texts = _stored_texts(spark, bronze, "theme_batches_short")
    return labelling.review_blocks(labelling.negative_sample(texts, HALF_SAMPLE), max_chars=SAMPLE).drop("review_ids")


@_query
def theme_parse(spark, bronze):
    return labelling.explode_labels(stand_ins.rule_answers(bronze.order_reviews))


def _cache(spark: SparkSession, name: str) -> ResultCache:
    return ResultCache(spark, _stored(spark, name))


@_query
def themes(spark, bronze):
    """Labels of every negative review by its whole text."""
    texts = _stored_texts(spark, bronze, "themes_texts")
    return labelling.build_themes(texts, stand_ins.id_labeler(), _cache(spark, "themes"), regenerate=True)


@_query
def theme_coverage(spark, bronze):
    """What becomes of the reviews when the labeler leaves out, repeats and invents ids."""
    texts = _stored_texts(spark, bronze, "theme_coverage_texts")
    cache = _cache(spark, "theme_coverage")
    return labelling.labelled_themes(texts, stand_ins.careless_labeler(), cache, regenerate=True).coverage()


@_query
def label_new_reviews(spark, bronze):
    """A stored sample, then every review: only those without a label are asked for."""
    texts = _stored_texts(spark, bronze, "label_new_reviews_texts")
    cache = _cache(spark, "label_new_reviews")
    labelling.build_themes(texts, stand_ins.drifting_labeler(1), cache, n_sample=HALF_SAMPLE, regenerate=True)
    return labelling.build_themes(texts, stand_ins.drifting_labeler(2), cache)


@_query
def labelled_stability(spark, bronze):
    """Two labelled runs of all negative reviews by a labeler that changes its mind in between."""
    texts = _stored_texts(spark, bronze, "labelled_stability_texts")
    labelers = stand_ins.drifting_labeler(1), stand_ins.drifting_labeler(2)
    return jobs.theme_stability(texts, _cache(spark, "labelled_stability"), *labelers)


@_query
def theme_stability(spark, bronze):
    return labelling.stability(_labels(bronze, 1), _labels(bronze, 2))


@_query
def theme_counts(spark, bronze):
    return theme_ops.theme_counts(_labels(bronze))


def _joined(spark: SparkSession, bronze: Bronze, name: str) -> DataFrame:
    """Labels with their reviews, stored for queries that read them several times."""
    labels = materialize(_labels(bronze), _stored(spark, f"{name}_labels"))
    return materialize(
        theme_ops.labels_with_reviews(labels, medallion.build_features(bronze)), _stored(spark, f"{name}_joined")
    )


@_query
def theme_examples(spark, bronze):
    return theme_ops.theme_examples(_joined(spark, bronze, "theme_examples"))


@_query
def theme_frequency(spark, bronze):
    return theme_ops.theme_frequency(_joined(spark, bronze, "theme_frequency"))


@_query
def theme_outcome_pivot(spark, bronze):
    joined = theme_ops.labels_with_reviews(
        _labels(bronze), medallion.build_features(bronze), unmatched="on_time"
    )
    return theme_ops.theme_outcome_pivot(joined)


@_query
def theme_summary(spark, bronze):
    first, second = _labels(bronze, 1), _labels(bronze, 2)
    return theme_ops.theme_summary(first, labelling.stability(first, second))


# Regions


@_query
def city_lateness(spark, bronze):
    cities = regional.city_lateness(medallion.build_features(bronze, text=False), CITY_MIN_ORDERS)
    return _rounded(cities, "late_rate", "avg_score", "lat", "lng")


@_query
def city_identities(spark, bronze):
    """One spelling for every city name of the customers."""
    return identity.city_identities(bronze.customers, _stored(spark, "city_identities"))


def _city_rates(spark: SparkSession, bronze: Bronze, name: str) -> DataFrame:
    """One stored row per city for queries that read it in several steps."""
    rates = outliers.group_rates(medallion.build_features(bronze, text=False))
    return materialize(rates, _stored(spark, name))


@_query
def city_lateness_shrunk(spark, bronze):
    """Late rates of all cities, small ones drawn towards the common rate by a fitted prior."""
    shrunk = outliers.shrunk_rates(_city_rates(spark, bronze, "city_lateness_shrunk"))
    strength = F.round(F.ln("prior_strength"), 3).alias("log_strength")
    rounded = _rounded(_rounded(shrunk, "late_rate", "prior_mean", "shrunk_rate"), "low", "high", digits=4)
    return rounded.select("*", strength).drop("prior_strength")


@_query
def city_funnel(spark, bronze):
    """Binomial control limits per city and false-discovery control over all of them."""
    limits = outliers.funnel(_city_rates(spark, bronze, "city_funnel"))
    return _rounded(limits, "baseline", "late_rate", "p_value", "q_value", "low_rate", "high_rate")


# Stored stages, caches, file sources and jobs


@_query
def staged_features(spark, bronze):
    stages = medallion.stage(bronze, _stored(spark, "staged_features"))
    return _rounded(stages.features, "customer_lat", "customer_lng")


def _gold_states(bronze: Bronze):
    """Three earlier states of the source tables, and these themselves.

    Reviews come late, one was removed that had won its id; orders are delivered later, payments,
    customers' cities and points of zips are corrected.
    """
    extra = bronze.order_reviews.filter("order_id % 50 = 7").withColumns(
        {"review_id": F.col("review_id") - 5, "review_answer_timestamp": F.lit("2999-01-01").cast("timestamp_ntz")}
    )
    no_date = F.when(F.col("order_id") % 7 != 3, F.col("order_delivered_customer_date"))
    moved = F.when(F.col("customer_id") % 11 == 0, F.lit("elsewhere")).otherwise(F.col("customer_city"))
    shifted = F.col("geolocation_lat") + F.when(F.col("geolocation_zip_code_prefix") % 5 == 2, 1.0).otherwise(0.0)
    first = replace(
        bronze,
        orders=bronze.orders.withColumn("order_delivered_customer_date", no_date),
        order_reviews=bronze.order_reviews.filter("order_id % 5 <> 0").unionByName(extra),
        order_payments=bronze.order_payments.filter("payment_installments < 3"),
        customers=bronze.customers.withColumn("customer_city", moved),
        geolocation=bronze.geolocation.withColumn("geolocation_lat", shifted),
    )
    second = replace(first, order_reviews=bronze.order_reviews)
    third = replace(second, orders=bronze.orders, order_payments=bronze.order_payments)
    return first, second, third, bronze


@_query
def gold_after_deltas(spark, bronze):
    """Gold of an early state of the source tables, brought up to date by three change sets."""
    root = f"{_stored(spark, 'gold_after_deltas')}/{uuid.uuid4().hex}"
    # The other tables are read off the files as they are.
    bronze = replace(bronze, **{t: materialize(bronze.tables()[t], f"{root}/{t}") for t in ("orders", "order_reviews")})
    store = IncrementalGold(spark, root, partitions=8)
    before, *later = _gold_states(bronze)
    store.create(before)
    for after in later:
        pairs = ((t, before.tables()[t], after.tables()[t], k) for t, k in KEYS.items())
        store.apply(after, Changes(**{t: changed_keys(old, new, k) for t, old, new, k in pairs if old is not new}))
        before = after
    return _rounded(store.read(), "customer_lat", "customer_lng")


@_query
def cache_roundtrip(spark, bronze):
    cache = ResultCache(spark, _stored(spark, "cache_roundtrip"))
    cache.load_or_build(
        "payments", lambda: medallion.build_silver(bronze).order_payments_agg, regenerate=True
    )
    return cache.load_or_build("payments", lambda: spark.range(0))


@_query
def cache_follows_inputs(spark, bronze):
    """A stored summary is built anew when its input changes, and loaded when only the order of the rows does."""
    cache = _cache(spark, "cache_follows_inputs")

    def summary(payments: DataFrame, build=None) -> DataFrame:
        build = build or (lambda: silver_ops.order_payments_agg(payments))
        return cache.load_or_build("payments", build, inputs={"order_payments": payments})

    summary(bronze.order_payments)
    later = bronze.order_payments.filter("payment_installments > 1")
    summary(later)
    return summary(later.repartition(5, "payment_value"), build=lambda: spark.range(0))


def _write_csv(frame: DataFrame, path: str, compression: str = "none") -> None:
    (
        frame.write.mode("overwrite")
        .option("header", True)
        .option("compression", compression)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


#: Bytes of the blocks in which ``csv_reviews_in_blocks`` reads its file.
CSV_BLOCK = 1 << 17


@_query
def csv_reviews_in_blocks(spark, bronze):
    """All reviews in CSV files with line breaks in quotes, every file written by one task and read by many."""
    root = _stored(spark, "csv_reviews_in_blocks")
    _write_csv(bronze.order_reviews.drop("has_text", "text_digest"), f"{root}/order_reviews.csv")
    session = spark.newSession()
    for key in ("maxPartitionBytes", "openCostInBytes"):
        session.conf.set(f"spark.sql.files.{key}", str(CSV_BLOCK))
    return tune(session) and Sources(root, "csv", "{table}.csv").read(session, "order_reviews")


@_query
def csv_gold(spark, bronze):
    """The source tables written as CSV, read back by prefix and taken to gold."""
    root = _stored(spark, "csv_gold")
    for name, frame in bronze.tables().items():
        # Files of one task each can be read whole; those with multi-line texts are divided, so they stay plain.
        _write_csv(frame, f"{root}/{name}.csv", "none" if name in MULTI_LINE else "gzip")
    gold = medallion.load_gold(spark, Sources(root, "csv", "{table}.csv"))
    return _rounded(gold, "customer_lat", "customer_lng")


@_query
def parquet_score_by_outcome(spark, bronze):
    """The source tables as Parquet files below one prefix."""
    root = _stored(spark, "parquet_sources")
    for name, frame in bronze.tables().items():
        frame.write.mode("overwrite").parquet(f"{root}/{name}")
    gold = medallion.load_gold(spark, Sources(root, "parquet"))
    return profile.score_by_outcome(feature_ops.add_features(gold))


@_query
def catalog_score_by_outcome(spark, bronze):
    """The source tables as names in the session catalog."""
    bronze.create_views("punctual_")
    gold = medallion.load_gold(spark, Sources(fmt="table", pattern="punctual_{table}"))
    return profile.score_by_outcome(feature_ops.add_features(gold))


@_query
def sentiment_job(spark, bronze):
    features = medallion.build_features(bronze)
    cache = ResultCache(spark, _stored(spark, "sentiment_job"))
    return jobs.sentiment_job(
        features, cache, stand_ins.star_model(), stand_ins.lexicon(spark), regenerate=True
    ).summary


def _theming(spark: SparkSession, bronze: Bronze, name: str):
    texts = _stored_texts(spark, bronze, f"{name}_texts")
    return jobs.theming_job(texts, _cache(spark, name), stand_ins.id_labeler(), regenerate=True, again=stand_ins.drifting_labeler(2))


@_query
def theming_job(spark, bronze):
    return _theming(spark, bronze, "theming_job")[0].summary


@_query
def theming_chart(spark, bronze):
    """The theming job's chart rows in display order, numbered."""
    chart = _theming(spark, bronze, "theming_chart")[1]
    order = Window.orderBy("theme_rank", outcome_rank(F.col("delivery_outcome")))
    return chart.withColumn("place", F.row_number().over(order)).drop("example")


def _analysis(spark: SparkSession, bronze: Bronze, name: str) -> dict[str, DataFrame]:
    return analyse(
        bronze, _cache(spark, name), stand_ins.star_model(), stand_ins.lexicon(spark), stand_ins.id_labeler(),
        regenerate_sentiment=True, regenerate_themes=True, min_orders=CITY_MIN_ORDERS,
    )


@_query
def analysis_score_by_outcome(spark, bronze):
    """One table of the whole analysis from source tables through stored layers."""
    return _analysis(spark, bronze, "analysis_score")["score_by_outcome"]


@_query
def analysis_theme_counts(spark, bronze):
    return _analysis(spark, bronze, "analysis_themes")["theme_counts"]
