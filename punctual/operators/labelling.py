"""Theme labels from a pluggable labeler: batch, ask, store, parse, clamp, check what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from punctual.functions import theme_json
from punctual.functions.numeric import mean_flag
from punctual.functions.text import prompt_line
from punctual.operators.features import negative_text_reviews
from punctual.operators.sampling import sample_ranked, with_batch
from punctual.sources.cache import ResultCache

# A labeler turns one prompt into the text of an answer.
Labeler = Callable[[str], str]

# Reviews per prompt, seed, calls per review.
BATCH_SIZE, SEED, ATTEMPTS = 25, 42, 2
# Prompts of one task: what a lost task asks again at most.
TASK_PROMPTS = 16

RUN_SCHEMA = "batch_id bigint, review_ids array<string>, answer string"

INSTRUCTIONS = (
    "Below are negative customer reviews, one per line. Choose for each review the single theme "
    "that names its main complaint, out of:\n"
    + "\n".join(f"- {theme}" for theme in theme_json.THEMES)
    + "\nAlso choose a severity: low, medium or high.\n"
    "Answer with a JSON array only, one object per review, in the form\n"
    '[{"review_id": "...", "theme": "...", "severity": "..."}]\n'
    "Reviews:\n"
)


def negative_sample(features: DataFrame, n_sample: int | None = None, seed: int = SEED) -> DataFrame:
    """Negative reviews with text; ``rank`` is the position in the sampling order.

    All of them, unless ``n_sample`` asks for a sample. Ids are picked first; the text joins the
    picked rows. Reviews without an id cannot be labelled and are left out.
    """
    negative = negative_text_reviews(features).filter(F.col("review_id").isNotNull())
    ranked = sample_ranked(negative.select("review_id"), "review_id", n_sample, seed)
    return negative.join(ranked, "review_id", "inner")


def review_blocks(
    sample: DataFrame, batch_size: int = BATCH_SIZE, max_chars: int | None = None
) -> DataFrame:
    """(batch_id, n_reviews, review_ids, reviews): ids and newline-joined prompt lines of each batch.

    A group holds at most ``batch_size`` rows. Whole texts, unless ``max_chars`` cuts them.
    """
    lines = with_batch(sample, batch_size).select(
        "batch_id",
        F.struct(
            "rank",
            F.col("review_id").cast("string").alias("id"),
            prompt_line(F.col("review_id"), F.col("review_comment_message"), max_chars).alias("line"),
        ).alias("entry"),
    )
    ordered = F.array_sort(F.collect_list("entry"))
    return lines.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.transform(ordered, lambda e: e["id"]).alias("review_ids"),
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("reviews"),
    )


def ask_labeler(prompts: DataFrame, labeler: Labeler, tasks: int) -> DataFrame:
    """(batch_id, review_ids, answer): one call per prompt, in ``tasks`` tasks.

    How many calls run at the same time is up to the cores the application has. An answer is kept
    as it comes; every evaluation calls the labeler, so store the result before using it twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [labeler(prompt) for prompt in frame["prompt"]]
            yield pd.DataFrame({"batch_id": frame["batch_id"], "review_ids": frame["review_ids"], "answer": answers})

    calls = prompts.select("batch_id", "review_ids", "prompt").repartition(max(tasks, 1))
    return calls.mapInPandas(run, RUN_SCHEMA)


def explode_labels(answers: DataFrame) -> DataFrame:
    """One row (review_id, theme, severity) per label; themes outside the vocabulary clamped.

    ``asked`` says whether the prompt held the id, where the answers carry their ``review_ids``.
    """
    label = F.explode(theme_json.parse_labels(F.col("answer"))).alias("label")
    rows = answers.select(label, *[c for c in ("review_ids",) if c in answers.columns]).select(
        "label.*",
        *[F.array_contains("review_ids", F.col("label.review_id")).alias("asked") for c in answers.columns if c == "review_ids"],
    )
    return rows.withColumn("theme", theme_json.clamp_theme(F.col("theme")))


@dataclass(frozen=True)
class Labelled:
    """``labels``: one row per labelled review. ``missing``: reviews without a label after all
    attempts. ``foreign``: labels in answers whose id is missing or was not in the prompt."""

    labels: DataFrame
    missing: DataFrame
    foreign: DataFrame

    def coverage(self) -> DataFrame:
        """One row: asked, labelled, missing, foreign."""
        counts = [
            frame.agg(F.count(F.lit(1)).alias(name))
            for name, frame in (("labelled", self.labels), ("missing", self.missing), ("foreign", self.foreign))
        ]
        joined = counts[0].select(
            "labelled", *[frame.select(frame.columns[0]).scalar().alias(frame.columns[0]) for frame in counts[1:]]
        )
        return joined.select((F.col("labelled") + F.col("missing")).alias("asked"), "labelled", "missing", "foreign")


def stored_labels(sample: DataFrame, cache: ResultCache, name: str) -> Labelled:
    """What the stored runs of ``name`` say about the reviews of ``sample``."""
    rows = explode_labels(cache.runs(name, RUN_SCHEMA))
    ids = sample.select(F.col("review_id").cast("string").alias("review_id"))
    known = one_label_per_review(rows.filter("asked")).join(ids, "review_id", "left_semi")
    return Labelled(
        labels=known,
        missing=ids.join(known.select("review_id"), "review_id", "left_anti"),
        foreign=rows.filter(~F.coalesce("asked", F.lit(False))),
    )


def label_sample(
    sample: DataFrame,
    labeler: Labeler,
    cache: ResultCache,
    name: str,
    batch_size: int = BATCH_SIZE,
    max_chars: int | None = None,
    instructions: str = INSTRUCTIONS,
    attempts: int = ATTEMPTS,
    task_prompts: int = TASK_PROMPTS,
    seed: int = SEED,
) -> Labelled:
    """Ask for every review of ``sample`` that no stored run of ``name`` labels, ``attempts`` times at most.

    Each attempt asks for what is still missing, in full batches, and is stored as one more run:
    after a crash the next call goes on from the complete runs and asks nothing twice. A review is
    labelled when the answer to a prompt that held it names it; whatever else answers say is in
    ``foreign``, and reviews that stay without a label are in ``missing``.
    """
    for _ in range(attempts):
        left = stored_labels(sample, cache, name).missing.withColumnRenamed("review_id", "_left")
        todo = sample.join(left, F.col("review_id").cast("string") == F.col("_left"), "left_semi").drop("rank")
        todo = cache.save(f"{name}/todo", todo)
        prompts = cache.save(f"{name}/prompts", review_blocks(sample_ranked(todo, "review_id", None, seed), batch_size, max_chars))
        n_prompts = prompts.count()
        if not n_prompts:
            break
        prompts = prompts.withColumn("prompt", F.concat(F.lit(instructions), F.col("reviews")))
        cache.append(name, ask_labeler(prompts, labeler, -(-n_prompts // task_prompts)))
    return stored_labels(sample, cache, name)


def build_themes(
    features: DataFrame,
    labeler: Labeler,
    cache: ResultCache,
    name: str = "themes",
    n_sample: int | None = None,
    seed: int = SEED,
    regenerate: bool = False,
    on_missing: str = "fail",
    **options,
) -> DataFrame:
    """Labels of all negative reviews with text, or of ``n_sample`` of them.

    Stored labels are not asked for again unless ``regenerate`` starts a new generation; so a later
    call labels only what is new. Reviews that get no label fail the job after everything is stored
    (``on_missing="fail"``) or are left out of the result (``"report"``; see ``labelled_themes``).
    ``options`` go to ``label_sample``.
    """
    done = labelled_themes(features, labeler, cache, name, n_sample, seed, regenerate, **options)
    if on_missing == "fail" and (n := done.missing.count()):
        raise ValueError(f"{n} reviews of {name!r} got no label")
    return done.labels


def labelled_themes(
    features: DataFrame,
    labeler: Labeler,
    cache: ResultCache,
    name: str = "themes",
    n_sample: int | None = None,
    seed: int = SEED,
    regenerate: bool = False,
    **options,
) -> Labelled:
    """``build_themes`` with what is missing and what is foreign beside the labels."""
    runs = cache.generation(name, new=regenerate)
    return label_sample(negative_sample(features, n_sample, seed), labeler, cache, runs, seed=seed, **options)


def one_label_per_review(labels: DataFrame) -> DataFrame:
    """The smallest (theme, severity) per review; repeated ids would multiply in a join."""
    first = Window.partitionBy("review_id").orderBy(F.col("theme").asc_nulls_first(), F.col("severity").asc_nulls_first())
    return (
        labels.filter(F.col("review_id").isNotNull())
        .select("review_id", "theme", "severity", F.row_number().over(first).alias("_place"))
        .filter("_place = 1")
        .drop("_place")
    )


def stability(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Share of reviews that carry the same theme in two runs, over the reviews in both."""
    both = (
        one_label_per_review(run_a)
        .select("review_id", F.col("theme").alias("a"))
        .join(
            one_label_per_review(run_b).select("review_id", F.col("theme").alias("b")),
            "review_id",
            "inner",
        )
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_both"), mean_flag(F.col("a") == F.col("b")).alias("stability")
    )
