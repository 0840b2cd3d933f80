import pytest
from pyspark.sql import functions as F

from punctual.functions.text import theme_name
from punctual.operators import themes as ops


def joined(spark, unmatched="drop"):
    labels = spark.createDataFrame(
        [
            ("1", "late_delivery", "low"),
            ("2", "late_delivery", "low"),
            ("3", "late_delivery", "high"),
            ("4", "other", "low"),
            ("404", "never_arrived", "low"),
            ("405", "other", "low"),
        ],
        "review_id string, theme string, severity string",
    )
    features = spark.createDataFrame(
        [(1, True, None), (2, True, "b" * 130), (3, False, "c"), (4, False, None), (5, False, "unlabelled")],
        "review_id long, is_late boolean, review_comment_message string",
    )
    return ops.labels_with_reviews(labels, features, unmatched)


def test_unmatched_labels_have_no_outcome_and_drop_out(spark):
    rows = ops.theme_frequency(joined(spark)).collect()
    got = {(r.theme, r.delivery_outcome): (r.n, r.theme_total, r.theme_rank, r.example) for r in rows}
    assert got == {
        ("late_delivery", "Late"): (2, 3, 1, "b" * 130),
        ("late_delivery", "On-time"): (1, 3, 1, "b" * 130),
        ("other", "On-time"): (1, 2, 2, None),
    }


def test_unmatched_labels_may_count_as_on_time(spark):
    rows = ops.theme_outcome_pivot(joined(spark, "on_time")).collect()
    assert {r.theme: (r.n_on_time, r.n_late, r.total) for r in rows} == {
        "late_delivery": (1, 2, 3),
        "other": (2, 0, 2),
        "never_arrived": (1, 0, 1),
    }
    dropped = ops.theme_outcome_pivot(joined(spark)).collect()
    assert {r.theme for r in dropped} == {"late_delivery", "other"}
    with pytest.raises(ValueError):
        joined(spark, "keep")


def test_examples(spark):
    assert [tuple(r) for r in ops.theme_examples(joined(spark)).collect()] == [("late_delivery", "b" * 130)]


def test_examples_can_be_cut(spark):
    assert ops.theme_examples(joined(spark), max_chars=120).first().example == "b" * 120


def test_summary_escapes_theme_names(spark):
    labels = spark.createDataFrame([("1", 'a"b\\c')], "review_id string, theme string")
    stability = spark.createDataFrame([(1.0,)], "stability double")
    import json

    assert json.loads(ops.theme_summary(labels, stability).first().freq) == {'a"b\\c': 1}


def test_summary_orders_frequencies(spark):
    labels = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", "b"), ("4", "c")], "review_id string, theme string")
    stability = spark.createDataFrame([(0.957,)], "stability double")
    assert tuple(ops.theme_summary(labels, stability).first()) == (4, 95.7, '{"b": 2, "a": 1, "c": 1}')


def test_display_names(spark):
    frame = spark.createDataFrame([("refund_or_billing",), ("new_theme-x2y",), ("ÉTÉ_a",)], "t string")
    names = [r.n for r in frame.select(theme_name(F.col("t")).alias("n")).collect()]
    assert names == ["Refund / Billing", "new_theme-x2y".replace("_", " ").title(), "ÉTÉ a".title()]
