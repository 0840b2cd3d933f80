"""Two sentiment methods over review text, checked against the stars and each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions import polarity
from punctual.functions.numeric import mean_flag, percent
from punctual.functions.text import shorten, words
from punctual.operators.features import text_reviews
from punctual.operators.sampling import sample_rows

# A loader returns a function from a list of texts to a list of labels such as "4 stars".
ModelLoader = Callable[[], Callable[[list[str]], list[str]]]

# Fixed value: the normalisation constant of the lexicon score (Hutto & Gilbert, 2014).
COMPOUND_ALPHA = 15


def with_model_stars(
    frame: DataFrame, text: str, load_model: ModelLoader, batch_size: int = 64
) -> DataFrame:
    """Add ``star_a``: the model is loaded once per Python worker and fed whole texts.

    The texts of a batch stay in Arrow; only ``batch_size`` of them at a time are Python strings.
    """

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for texts in batches:
            labels = []
            for start in range(0, len(texts), batch_size):
                labels.extend(model(texts.slice(start, batch_size).to_pylist()))
            yield pa.array(labels, pa.string())

    labels = F.arrow_udf(score, "string")(F.col(text).cast("string"))
    return frame.withColumn("star_a", polarity.stars_from_label(labels))


def with_lexicon_compound(frame: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """Replace ``text`` by ``compound_b`` in [-1, 1]; the other columns must hold a unique key.

    ``lexicon`` has one row (token, valence) per token. Words are exploded and matched by a join
    without a hint: a lexicon below the broadcast threshold is sent to the scan tasks, so words
    never leave them and only partial sums are shuffled; a larger one is sort-merged, with hot
    words split. Valences are summed as decimals, so the score does not depend on word order.
    """
    keys = [c for c in frame.columns if c != text]
    entries = lexicon.select("token", F.col("valence").cast("decimal(9,4)").alias("valence"))
    total = F.coalesce(F.sum("valence"), F.lit(0)).cast("double")
    return (
        frame.select(*keys, F.explode_outer(words(F.col(text))).alias("token"))
        .join(entries, "token", "left")
        .groupBy(*keys)
        .agg(total.alias("_s"))
        .withColumn(
            "compound_b",
            F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + COMPOUND_ALPHA), 4),
        )
        .drop("_s")
    )


def with_labels(scored: DataFrame) -> DataFrame:
    """Three-way labels, agreement of the methods and validity of each against the stars."""
    return (
        scored.withColumns(
            {
                "label_a": polarity.stars_to_polarity(F.col("star_a")),
                "label_b": polarity.compound_to_polarity(F.col("compound_b")),
                "label_truth": polarity.stars_to_polarity(F.col("review_score")),
            }
        )
        .withColumns(
            {
                "ab_agree": F.col("label_a") == F.col("label_b"),
                "a_valid": F.col("label_a") == F.col("label_truth"),
                "b_valid": F.col("label_b") == F.col("label_truth"),
            }
        )
        .select(
            "review_id",
            "star_a",
            "compound_b",
            "review_score",
            "label_a",
            "label_b",
            "label_truth",
            "ab_agree",
            "a_valid",
            "b_valid",
        )
    )


def build_sentiment(
    features: DataFrame, load_model: ModelLoader, lexicon: DataFrame, batch_size: int = 64
) -> DataFrame:
    """Both methods over the reviews with text, keyed by review id; one shuffle in total."""
    scored = with_model_stars(
        text_reviews(features), "review_comment_message", load_model, batch_size
    )
    return with_labels(with_lexicon_compound(scored, "review_comment_message", lexicon))


def sentiment_summary(sentiment: DataFrame) -> DataFrame:
    """One row: size, validity of each method, agreement, number of disagreements."""
    return sentiment.agg(
        F.count(F.lit(1)).alias("n"),
        percent(mean_flag(F.col("a_valid"))).alias("a_valid_pct"),
        percent(mean_flag(F.col("b_valid"))).alias("b_valid_pct"),
        percent(mean_flag(F.col("ab_agree"))).alias("ab_agree_pct"),
        F.count_if(~F.col("ab_agree")).alias("disagree_n"),
    )


def disagreements(sentiment: DataFrame, features: DataFrame) -> DataFrame:
    """The reviews the methods split on, with their text. They are inspected, never dropped."""
    return sentiment.filter(~F.col("ab_agree")).join(
        features.select("review_id", "review_comment_message"), "review_id", "inner"
    )


def disagreement_examples(
    sentiment: DataFrame, features: DataFrame, n: int = 3, seed: int = 1, max_chars: int | None = None
) -> DataFrame:
    """A reproducible handful of disagreements for reading, cut to ``max_chars`` only if asked for.

    Ids are picked first; the text joins the few picked rows.
    """
    picked = sample_rows(sentiment.filter(~F.col("ab_agree")), "review_id", n, seed)
    texts = features.select("review_id", "review_comment_message")
    return picked.join(texts, "review_id", "inner").select(
        "review_id",
        "review_score",
        "label_a",
        "label_b",
        shorten(F.col("review_comment_message"), max_chars).alias("excerpt"),
    )
