"""The whole analysis: stored features, stored model results, every report table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.delivery import outcome_rank
from punctual.operators import distributions, profile, regional, sentiment as sentiment_ops
from punctual.operators import themes as theme_ops
from punctual.operators.gold import grain_check
from punctual.operators.labelling import Labeler, build_themes
from punctual.plans.medallion import stage
from punctual.sources.bronze import Bronze
from punctual.sources.cache import ResultCache


def quantitative(features: DataFrame) -> dict[str, DataFrame]:
    """Rates and distributions by delivery outcome."""
    return {
        "grain_check": grain_check(features),
        "headline_rates": profile.headline_rates(features),
        "score_by_outcome": profile.score_by_outcome(features),
        "score_share_by_outcome": distributions.score_share_by_outcome(features),
        "gap_histogram": distributions.gap_histogram_equal_width(features),
    }


def report(
    features: DataFrame,
    sentiment: DataFrame,
    labels: DataFrame,
    min_orders: int = regional.MIN_ORDERS,
) -> dict[str, DataFrame]:
    """Every table of the analysis, from frames that are already stored.

    All of them read ``features``, so it should be a materialised table, not a lazy plan.
    """
    joined = theme_ops.labels_with_reviews(labels, features)
    return {
        **quantitative(features),
        "sentiment_summary": sentiment_ops.sentiment_summary(sentiment),
        "disagreement_examples": sentiment_ops.disagreement_examples(sentiment, features),
        "theme_counts": theme_ops.theme_counts(labels),
        "theme_frequency": theme_ops.theme_frequency(joined).orderBy(
            "theme_rank", outcome_rank(F.col("delivery_outcome"))
        ),
        "city_lateness": regional.city_lateness(features, min_orders),
    }


def analyse(
    bronze: Bronze,
    cache: ResultCache,
    load_model: sentiment_ops.ModelLoader,
    lexicon: DataFrame,
    labeler: Labeler,
    regenerate_sentiment: bool = False,
    regenerate_themes: bool = False,
    min_orders: int = regional.MIN_ORDERS,
    n_sample: int | None = None,
) -> dict[str, DataFrame]:
    """Source tables to report tables.

    The layers are rebuilt and stored; model results are loaded when they exist, so a plain run
    calls the model never and the labeler only for reviews without a stored label: all negative
    ones, or ``n_sample`` of them.
    """
    features = stage(bronze, cache.path("stages")).features
    sentiment = cache.load_or_build(
        "sentiment",
        lambda: sentiment_ops.build_sentiment(features, load_model, lexicon),
        regenerate_sentiment,
    )
    labels = cache.save(
        "themes_table",
        build_themes(features, labeler, cache, n_sample=n_sample, regenerate=regenerate_themes),
    )
    buyers = {"one_time_buyers": profile.one_time_buyers(bronze.orders, bronze.customers)}
    return {**buyers, **report(features, sentiment, labels, min_orders)}


def store(tables: dict[str, DataFrame], cache: ResultCache, parallelism: int = 4) -> dict[str, DataFrame]:
    """Write report tables below the cache, with their jobs submitted side by side; returns the stored ones."""
    with ThreadPoolExecutor(parallelism) as pool:
        saved = pool.map(lambda item: cache.save(f"report/{item[0]}", item[1]), tables.items())
    return dict(zip(tables, saved, strict=True))
