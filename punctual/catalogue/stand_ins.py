"""Deterministic rules in place of a sentiment model, a lexicon and a labeler.

The model and the labeler are external services that a user plugs in; these rules let every step
around them run over the given tables and be checked in SQL. The factories return closures, so
Python workers need no import of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.theme_json import SEVERITIES, THEMES

# Fixed values: (token, valence) of the stand-in lexicon.
LEXICON = (
    ("worthless", -2.6),
    ("pathetic", -2.4),
    ("hate", -2.7),
    ("good", 1.9),
    ("with", 0.7),
    ("this", 0.3),
    ("that", -0.4),
    ("of", -0.1),
    ("and", 0.1),
    ("the", 0.05),
    ("not", -0.8),
    ("que", 0.6),
    ("les", -0.5),
    ("la", 0.2),
    ("und", 0.9),
    ("nicht", -1.1),
    ("é", 0.8),
    ("über", 0.4),
    ("más", 0.5),
    ("los", -0.3),
)


def lexicon(spark: SparkSession) -> DataFrame:
    """The lexicon as an inline table: its size is known, so it is broadcast before any word is shuffled."""
    rows = ", ".join(f"('{token}', {valence}D)" for token, valence in LEXICON)
    return spark.sql(f"SELECT token, valence FROM VALUES {rows} AS t(token, valence)")


def star_model():
    """Loader of a model that derives the stars from the length of the text."""

    def load():
        def label(texts: list[str]) -> list[str]:
            stars = [len(text) % 5 + 1 for text in texts]
            return [f"{n} star" if n == 1 else f"{n} stars" for n in stars]

        return label

    return load


def id_labeler():
    """Labeler that derives theme and severity from the review id.

    One id in nine gets a theme outside the vocabulary; answers come plain, fenced or in prose.
    """
    themes, severities = list(THEMES) + ["something_else"], list(SEVERITIES)

    def answer(prompt: str) -> str:
        import json
        import re

        ids = [int(i) for i in re.findall(r"^- review_id=(\d+): ", prompt, re.MULTILINE)]
        rows = [
            {"review_id": str(i), "theme": themes[i % 9], "severity": severities[i % 3]} for i in ids
        ]
        text = json.dumps(rows)
        style = sum(ids) % 3
        if style == 1:
            return f"```json\n{text}\n```"
        if style == 2:
            return f"Here are the labels:\n{text}\nDone."
        return text

    return answer


def drifting_labeler(start: int):
    """Labeler whose later prompts move one review in ten to the next theme: ``start`` is the run."""
    themes, severities = list(THEMES), list(SEVERITIES)

    def answer(prompt: str) -> str:
        import json
        import re

        ids = [int(i) for i in re.findall(r"^- review_id=(\d+): ", prompt, re.MULTILINE)]
        moved = lambda i: (i + 1) % 8 if start == 2 and i % 10 == 3 else i % 8
        return json.dumps(
            [{"review_id": str(i), "theme": themes[moved(i)], "severity": severities[i % 3]} for i in ids]
        )

    return answer


def careless_labeler():
    """Labeler that never names every fifth id, names every seventh twice and invents one id per prompt."""
    rule = drifting_labeler(1)

    def answer(prompt: str) -> str:
        import json

        rows = [r for r in json.loads(rule(prompt)) if int(r["review_id"]) % 5]
        rows += [r for r in rows if int(r["review_id"]) % 7 == 0]
        return json.dumps([*rows, {"review_id": "x", "theme": "other", "severity": "low"}])

    return answer


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def rule_labels(order_reviews: DataFrame, run: int = 1) -> DataFrame:
    """Labels by rule for every raw negative review with text, as columns.

    The second run moves one review in ten to the next theme. Some labelled reviews are not in
    gold, so label tables meet unmatched ids.
    """
    review_id = F.col("review_id")
    index = F.pmod(review_id, F.lit(8))
    if run == 2:
        index = F.when(F.pmod(review_id, F.lit(10)) == 3, F.pmod(index + 1, F.lit(8))).otherwise(index)
    return (
        order_reviews.filter("review_score <= 2 AND review_comment_message IS NOT NULL")
        .select("review_id")
        .distinct()
        .select(
            review_id.cast("string").alias("review_id"),
            _pick(THEMES, index).alias("theme"),
            _pick(SEVERITIES, F.pmod(review_id, F.lit(3))).alias("severity"),
        )
    )


def rule_answers(order_reviews: DataFrame) -> DataFrame:
    """Answers as a labeler would write them, one per 25 consecutive ids of negative reviews.

    By batch number: plain array, fenced array, array in prose, truncated array. One id in nine
    has no theme and one has a theme outside the vocabulary.
    """
    review_id = F.col("review_id")
    kind = F.pmod(review_id, F.lit(9))
    theme = F.when(kind == 8, "something_else").when(kind < 7, _pick(THEMES, F.least(kind, F.lit(7))))
    rows = (
        order_reviews.filter("review_score <= 2 AND review_comment_message IS NOT NULL")
        .select("review_id")
        .distinct()
        .select(
            F.floor(review_id / 25).alias("batch_id"),
            F.struct(
                review_id.cast("string").alias("review_id"),
                theme.alias("theme"),
                _pick(SEVERITIES, F.pmod(review_id, F.lit(3))).alias("severity"),
            ).alias("row"),
        )
    )
    array = F.to_json(F.array_sort(F.collect_list("row")))
    style = F.pmod(F.col("batch_id"), F.lit(4))
    # Distinct ids: a batch holds at most 25 rows.
    return rows.groupBy("batch_id").agg(array.alias("array")).select(
        "batch_id",
        F.when(style == 0, F.col("array"))
        .when(style == 1, F.concat(F.lit("```json\n"), "array", F.lit("\n```")))
        .when(style == 2, F.concat(F.lit("Here you are:\n"), "array", F.lit("\nDone.")))
        .otherwise(F.expr("left(array, length(array) - 1)"))
        .alias("answer"),
    )
