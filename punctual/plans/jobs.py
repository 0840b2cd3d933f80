"""The two long-running jobs: sentiment scoring and theme labelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.delivery import outcome_rank
from punctual.operators import labelling, themes
from punctual.operators.sentiment import ModelLoader, build_sentiment, sentiment_summary
from punctual.sources.cache import ResultCache


@dataclass(frozen=True)
class JobResult:
    result: DataFrame
    summary: DataFrame


def sentiment_job(
    features: DataFrame,
    cache: ResultCache,
    load_model: ModelLoader,
    lexicon: DataFrame,
    regenerate: bool = False,
) -> JobResult:
    """Score once, keep the scores, summarise."""
    scored = cache.load_or_build(
        "sentiment", lambda: build_sentiment(features, load_model, lexicon), regenerate
    )
    return JobResult(scored, sentiment_summary(scored))


def theme_stability(
    features: DataFrame, cache: ResultCache, labeler: labelling.Labeler, again: labelling.Labeler | None = None, **options
) -> DataFrame:
    """Label the same reviews twice and report how often the theme is the same.

    Each run is a stored generation of its own; ``again`` may be another labeler for the second one.
    """
    runs = [
        labelling.build_themes(features, run, cache, name, regenerate=True, **options)
        for name, run in (("stability_a", labeler), ("stability_b", again or labeler))
    ]
    return labelling.stability(*runs)


def theming_job(
    features: DataFrame,
    cache: ResultCache,
    labeler: labelling.Labeler,
    regenerate: bool = False,
    again: labelling.Labeler | None = None,
    **options,
) -> tuple[JobResult, DataFrame]:
    """Label the negative reviews (kept), label them again (by ``again``, if given), compare; returns labels, summary and chart data."""
    build = labelling.build_themes
    first = cache.save("themes_table", build(features, labeler, cache, "themes", regenerate=regenerate, **options))
    second = build(features, again or labeler, cache, "themes_check", regenerate=True, **options)
    summary = themes.theme_summary(first, labelling.stability(first, second))
    chart = themes.theme_frequency(themes.labels_with_reviews(first, features))
    return JobResult(first, summary), chart.orderBy("theme_rank", outcome_rank(F.col("delivery_outcome")))
