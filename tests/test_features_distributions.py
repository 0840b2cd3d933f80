import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.functions import delivery, polarity
from punctual.operators import distributions, profile, regional
from punctual.operators.features import add_features

D = dt.datetime


def features_of(spark, rows):
    schema = (
        "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz, "
        "review_score int, has_text int"
    )
    return add_features(spark.createDataFrame(rows, schema))


def test_lateness_at_the_boundary(spark):
    due = D(2018, 1, 10)
    micro = dt.timedelta(microseconds=1)
    rows = features_of(
        spark, [(due + micro, due, 1, 1), (due, due, 2, 0), (due - micro, due, 3, 1), (due, None, None, 0)]
    ).collect()
    assert [r.is_late for r in rows] == [True, False, False, False]
    assert [r.delivery_outcome for r in rows] == ["Late", "On-time", "On-time", "On-time"]
    assert [r.is_negative for r in rows] == [True, True, False, False]
    assert [r.has_text for r in rows] == [True, False, True, False]
    assert rows[0].delivery_gap_days == -1e-6 / 86400 and rows[3].delivery_gap_days is None


def test_gap_ignores_clock_changes_of_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # Clocks went forward at midnight of 2018-11-04: 00:30 did not exist.
        rows = [
            (D(2018, 11, 3, 12), D(2018, 11, 5, 12), 5, 1),
            (D(2018, 11, 4, 0, 30), D(2018, 11, 5, 0, 30), 5, 1),
        ]
        assert [r.delivery_gap_days for r in features_of(spark, rows).collect()] == [2.0, 1.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dates_may_arrive_as_text(spark):
    frame = spark.createDataFrame(
        [("2018-01-01 00:00:00", "2018-01-02 12:00:00", 1, True)],
        "order_delivered_customer_date string, order_estimated_delivery_date string, "
        "review_score int, has_text boolean",
    )
    assert add_features(frame).first().delivery_gap_days == 1.5


def test_clip_keeps_missing_values(spark):
    frame = spark.createDataFrame([(-31.0,), (61.0,), (1.5,), (None,)], "v double")
    assert [r.c for r in frame.select(delivery.clip(F.col("v"), -30, 60).alias("c")).collect()] == [
        -30.0,
        60.0,
        1.5,
        None,
    ]


def test_polarity(spark):
    stars = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "s int")
    assert [r.p for r in stars.select(polarity.stars_to_polarity(F.col("s")).alias("p")).collect()] == [
        "negative",
        "negative",
        "neutral",
        "positive",
        "positive",
        "positive",
    ]
    values = [-0.05, -0.0499, 0.0, 0.0499, 0.05, float("nan"), None]
    frame = spark.createDataFrame([(v,) for v in values], "c double")
    assert [r.p for r in frame.select(polarity.compound_to_polarity(F.col("c")).alias("p")).collect()] == [
        "negative",
        "neutral",
        "neutral",
        "neutral",
        "positive",
        "neutral",
        "neutral",
    ]
    labels = spark.createDataFrame([("1 star",), ("4 stars",)], "l string")
    assert [r.n for r in labels.select(polarity.stars_from_label(F.col("l")).alias("n")).collect()] == [1, 4]


def gaps_frame(spark, gaps):
    frame = spark.createDataFrame([(g,) for g in gaps], "delivery_gap_days double")
    late = delivery.is_late(F.col("delivery_gap_days"))
    return frame.withColumn("delivery_outcome", delivery.outcome(late))


def histogram(frame):
    counts, edges = {"On-time": {}, "Late": {}}, {}
    for r in frame.collect():
        counts[r.delivery_outcome][r.bin] = r.n
        edges[r.bin] = (r.bin_start, r.bin_end)
    return counts, edges


EDGE_GAPS = [-31.0, -30.0, -0.0001, 0.0, 59.999, 60.0, 61.0, None, 12.0, 12.0, -29.0]


def test_daily_histogram_equals_numpy(spark):
    counts, edges = histogram(distributions.gap_histogram_daily(gaps_frame(spark, EDGE_GAPS)))
    present = np.array([g for g in EDGE_GAPS if g is not None])
    clipped = np.clip(present, -30, 60)
    for name, mask in (("Late", present < 0), ("On-time", present >= 0)):
        want, _ = np.histogram(clipped[mask], bins=list(range(-30, 61)))
        assert [counts[name][b] for b in range(1, 91)] == want.tolist()
    assert edges[1] == (-30.0, -29.0) and edges[90] == (59.0, 60.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_width_histogram_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    low, high = rng.uniform(-40, -1), rng.uniform(5, 70)
    clip_low, clip_high = max(low, -30), min(high, 60)
    edge_values = np.histogram_bin_edges([clip_low, clip_high], bins=60)
    gaps = np.concatenate([rng.uniform(low, high, 300), edge_values, np.nextafter(edge_values, 100)])
    counts, edges = histogram(distributions.gap_histogram_equal_width(gaps_frame(spark, gaps.tolist())))
    clipped = np.clip(gaps, -30, 60)
    want_edges = np.histogram_bin_edges(clipped, bins=60)
    for name, mask in (("Late", gaps < 0), ("On-time", gaps >= 0)):
        want, _ = np.histogram(clipped[mask], bins=60, range=(clipped.min(), clipped.max()))
        assert [counts[name][b] for b in range(1, 61)] == want.tolist()
    assert [edges[b][0] for b in range(1, 61)] == want_edges[:-1].tolist()
    assert edges[60][1] == want_edges[-1]


def test_equal_width_histogram_of_one_value(spark):
    counts, edges = histogram(distributions.gap_histogram_equal_width(gaps_frame(spark, [5.0, 5.0, None])))
    want, want_edges = np.histogram([5.0, 5.0], bins=60)
    assert [counts["On-time"][b] for b in range(1, 61)] == want.tolist()
    assert (edges[1][0], edges[60][1]) == (want_edges[0], want_edges[-1])


def scored_frame(spark):
    rows = [("On-time", 5), ("On-time", 5), ("On-time", 1), ("Late", 1), ("Late", None)]
    return spark.createDataFrame(rows, "delivery_outcome string, review_score int")


def test_score_shares_sum_to_one_per_outcome(spark):
    shares = distributions.score_share_by_outcome(scored_frame(spark)).collect()
    assert {(r.delivery_outcome, r.review_score): r.proportion for r in shares} == {
        ("On-time", 5): pytest.approx(2 / 3),
        ("On-time", 1): pytest.approx(1 / 3),
        ("Late", 1): 1.0,
    }


def test_mean_score_skips_missing_scores(spark):
    rows = {r.delivery_outcome: r for r in profile.score_by_outcome(scored_frame(spark)).collect()}
    assert (rows["Late"].n_reviews, rows["Late"].mean_score) == (2, 1.0)
    assert rows["On-time"].mean_score == 3.67


def city_rows():
    rows = [("a", "SP", True, 1, -23.0), ("a", "RJ", False, 4, -21.0), ("a", "RJ", False, None, None)]
    rows += [("small", "SP", True, 1, 1.0)] * 2
    rows += [(None, "SP", True, 1, 1.0)] * 5
    rows += [("nowhere", "SP", True, 1, None)] * 4
    return rows


def test_city_lateness(spark):
    frame = spark.createDataFrame(
        city_rows(),
        "customer_city string, customer_state string, is_late boolean, review_score int, customer_lat double",
    ).withColumn("customer_lng", F.col("customer_lat") * 2)
    rows = regional.city_lateness(frame, min_orders=3).collect()
    assert len(rows) == 1
    city = rows[0]
    assert (city.customer_city, city.n, city.state) == ("a", 3, "RJ")
    assert math.isclose(city.late_rate, 1 / 3) and city.late_pct == "33.3%"
    assert (city.avg_score, city.avg_score_str) == (2.5, "2.5")
    assert (city.lat, city.lng) == (-22.0, -44.0)
