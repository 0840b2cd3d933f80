"""Theme tables: labels joined back to the reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.delivery import LATE, ON_TIME, outcome
from punctual.functions.numeric import percent
from punctual.functions.text import shorten, theme_name


def labels_with_reviews(labels: DataFrame, features: DataFrame, unmatched: str = "drop") -> DataFrame:
    """Left join of the labels with lateness and text.

    The features are reduced to the labelled ids first: that semi-join broadcasts the labels when
    they are small, so the full review table is not shuffled to meet a sample of labels. Labels
    without a review keep a missing outcome (``unmatched="drop"``, later grouping leaves them out)
    or count as on time (``"on_time"``).
    """
    if unmatched not in ("drop", "on_time"):
        raise ValueError(f"unmatched must be 'drop' or 'on_time', not {unmatched!r}")
    facts = features.select(
        F.col("review_id").cast(labels.schema["review_id"].dataType).alias("review_id"),
        "is_late",
        "review_comment_message",
    )
    wanted = facts.join(labels.select("review_id"), "review_id", "left_semi")
    label = outcome(F.col("is_late"))
    if unmatched == "on_time":
        label = F.coalesce(label, F.lit(ON_TIME))
    return labels.join(wanted, "review_id", "left").withColumn("delivery_outcome", label)


def theme_counts(labels: DataFrame) -> DataFrame:
    """Frequency of each theme."""
    return labels.groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


def _example_ids(joined: DataFrame) -> DataFrame:
    """(theme, review_id): the smallest review id with a text of each theme; no text moves for it."""
    first = Window.partitionBy("theme").orderBy("review_id")
    with_text = joined.filter(F.col("review_comment_message").isNotNull() & F.col("review_id").isNotNull())
    ranked = with_text.select("theme", "review_id", F.row_number().over(first).alias("place"))
    return ranked.filter("place = 1").drop("place")


def theme_examples(joined: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One example text per theme: that of the smallest review id with a text.

    The id of each theme is found first, then its text is fetched. ``joined`` is read twice: pass a
    stored table.
    """
    texts = joined.dropna(subset=["review_comment_message"])
    fetched = texts.join(_example_ids(joined), ["theme", "review_id"], "left_semi")
    return fetched.select("theme", shorten(F.col("review_comment_message"), max_chars).alias("example")).dropDuplicates(["theme"])


def theme_frequency(joined: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Counts per theme and outcome with the theme's total, rank and example text.

    Totals are windows over a theme's few outcome rows; examples join the counted rows. Ties in the
    ranking go by name. ``joined`` is read several times: pass a stored table.
    """
    per_outcome = joined.groupBy("theme", "delivery_outcome").agg(F.count(F.lit(1)).alias("n"))
    totals = per_outcome.withColumn("theme_total", F.sum("n").over(Window.partitionBy("theme")))
    # One row per theme and outcome reaches this window.
    ranked = totals.withColumn(
        "theme_rank", F.dense_rank().over(Window.orderBy(F.desc("theme_total"), "theme"))
    )
    shown = ranked.filter(F.col("delivery_outcome").isNotNull()).join(theme_examples(joined, max_chars), "theme", "left")
    return shown.select("theme", "delivery_outcome", "n", "theme_total", "theme_rank", "example")


def theme_outcome_pivot(joined: DataFrame) -> DataFrame:
    """One row per theme with both outcomes, zero where a combination is absent, and the total."""
    wide = (
        joined.groupBy("theme")
        .agg(
            F.count_if(F.col("delivery_outcome") == ON_TIME).alias("n_on_time"),
            F.count_if(F.col("delivery_outcome") == LATE).alias("n_late"),
        )
        .filter(F.col("n_on_time") + F.col("n_late") > 0)
    )
    return wide.select(
        "theme",
        theme_name(F.col("theme")).alias("display_name"),
        "n_on_time",
        "n_late",
        (F.col("n_on_time") + F.col("n_late")).alias("total"),
    )


def theme_summary(labels: DataFrame, stability: DataFrame) -> DataFrame:
    """One row: number of labels, stability and the frequencies as JSON, most frequent first.

    ``labels`` is reduced to one row per theme of the fixed vocabulary before anything is gathered.
    """
    counts = theme_counts(labels).withColumn(
        "entry", F.struct((-F.col("n")).alias("by"), F.col("theme").alias("theme"), F.col("n").alias("n"))
    )
    pairs = F.transform(
        F.array_sort(F.collect_list("entry")),
        lambda e: F.concat(
            F.lit('"'), F.regexp_replace(e["theme"], r'(["\\\\])', r"\\$1"), F.lit('": '), e["n"].cast("string")
        ),
    )
    summary = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("freq"),
    )
    score = stability.select("stability").scalar()
    return summary.select("n", percent(score).alias("stability_pct"), "freq")
