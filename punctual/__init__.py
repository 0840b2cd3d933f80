"""Delivery punctuality and review analytics on Spark DataFrames.

Typical use::

    from punctual import ResultCache, Sources, analyse

    bronze = Sources("s3a://bucket/raw", "csv", "{table}.csv").bronze(spark)
    tables = analyse(bronze, ResultCache(spark, "s3a://bucket/cache"), load_model, lexicon, labeler)
"""

from punctual.operators.features import add_features
from punctual.operators.labelling import build_themes
from punctual.operators.sentiment import build_sentiment
from punctual.plans.jobs import sentiment_job, theme_stability, theming_job
from punctual.plans.medallion import build_features, build_gold, load_gold, stage
from punctual.plans.report import analyse, report
from punctual.session import shared_folder, tune
from punctual.sources.bronze import Bronze, Sources
from punctual.sources.cache import ResultCache, materialize

__all__ = [
    "Bronze",
    "ResultCache",
    "Sources",
    "add_features",
    "analyse",
    "build_features",
    "build_gold",
    "build_sentiment",
    "build_themes",
    "load_gold",
    "materialize",
    "report",
    "sentiment_job",
    "shared_folder",
    "stage",
    "theme_stability",
    "theming_job",
    "tune",
]
