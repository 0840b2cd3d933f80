import math
import re

import pytest
from pyspark.sql import functions as F

from punctual.catalogue import stand_ins
from punctual.operators import sentiment as ops

WORDS = {"bom": 1.9, "péssimo": -2.5, "atrasado": -1.2, "über": 0.4}
TEXTS = {
    1: "O produto chegou muito atrasado, péssimo!",
    2: "Bom, BOM... e bom",
    3: "pessimo sem acento",
    4: "...!?",
    5: " ",
    6: "Über-bom\nbom",
}


def brute_force(text):
    tokens = re.findall(r"\w+", text.lower())
    s = sum(WORDS.get(t, 0.0) for t in tokens)
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(list(WORDS.items()), "token string, valence double")


def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "review_id int, message string")


def test_lexicon_scores_whole_texts(spark, lexicon):
    scored = ops.with_lexicon_compound(texts(spark), "message", lexicon)
    assert {r.review_id: r.compound_b for r in scored.collect()} == {
        k: pytest.approx(brute_force(t)) for k, t in TEXTS.items()
    }


def test_the_late_and_terrible_sentence_scores_below_zero_and_the_good_one_above(spark, lexicon):
    scored = {r.review_id: r.compound_b for r in ops.with_lexicon_compound(texts(spark), "message", lexicon).collect()}
    assert scored[1] < 0 < scored[2]


def test_large_lexicon_is_joined_without_a_broadcast_and_gives_the_same_scores(spark, lexicon):
    small = ops.with_lexicon_compound(texts(spark), "message", lexicon).collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = ops.with_lexicon_compound(texts(spark), "message", lexicon)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        assert sorted(frame.collect()) == sorted(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_model_sees_whole_texts_in_batches_of_the_given_size(spark):
    def load():
        def label(batch):
            assert len(batch) <= 2
            return [f"{min(5, 1 + len(text) // 5000)} stars" for text in batch]

        return label

    frame = spark.createDataFrame([(i, "x" * 5000 * i) for i in range(5)], "review_id int, message string")
    scored = ops.with_model_stars(frame.coalesce(1), "message", load, batch_size=2)
    assert {r.review_id: r.star_a for r in scored.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5}


def test_build_sentiment_keys_by_review_and_skips_reviews_without_text(spark, lexicon):
    features = texts(spark).select(
        F.col("review_id"),
        F.col("message").alias("review_comment_message"),
        F.lit(1).alias("review_score"),
        (F.col("review_id") != 4).alias("has_text"),
    )
    rows = ops.build_sentiment(features, stand_ins.star_model(), lexicon).collect()
    assert sorted(r.review_id for r in rows) == [1, 2, 3, 5, 6]
    for r in rows:
        assert r.ab_agree == (r.label_a == r.label_b)
        assert r.a_valid == (r.label_a == r.label_truth) and r.b_valid == (r.label_b == r.label_truth)


def sentiment_frame(spark):
    rows = [
        ("a", "negative", "negative", "negative"),
        ("b", "positive", "negative", "negative"),
        ("c", "neutral", "positive", "positive"),
    ]
    frame = spark.createDataFrame(rows, "review_id string, label_a string, label_b string, label_truth string")
    return frame.withColumns(
        {
            "review_score": F.lit(1),
            "ab_agree": F.col("label_a") == F.col("label_b"),
            "a_valid": F.col("label_a") == F.col("label_truth"),
            "b_valid": F.col("label_b") == F.col("label_truth"),
        }
    )


def test_summary_and_disagreements(spark):
    frame = sentiment_frame(spark)
    assert tuple(ops.sentiment_summary(frame).first()) == (3, 33.3, 100.0, 33.3, 2)
    features = spark.createDataFrame(
        [("a", "A"), ("b", "B" * 100), ("c", "C")], "review_id string, review_comment_message string"
    )
    split = ops.disagreements(frame, features)
    assert sorted(r.review_id for r in split.collect()) == ["b", "c"]
    cut = ops.disagreement_examples(frame, features, max_chars=70).collect()
    assert {r.review_id: len(r.excerpt) for r in cut} == {"b": 70, "c": 1}
    examples = ops.disagreement_examples(frame, features).collect()
    assert {r.review_id: len(r.excerpt) for r in examples} == {"b": 100, "c": 1}
