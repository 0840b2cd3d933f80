import hashlib
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from punctual.operators import bootstrap, quantiles, sampling


def gaps(spark, rows):
    return spark.createDataFrame([(o, g) for o, g in rows], "delivery_outcome string, delivery_gap_days double")


@pytest.mark.parametrize("kind", ["equal", "distinct", "mixed", "one"])
def test_gap_quantiles_are_exact(spark, kind):
    rng = random.Random(2)
    make = {
        "equal": lambda: [3.25] * 500,
        "distinct": lambda: [i * 1_000_003 / 1e6 / 86_400.0 for i in rng.sample(range(-10**6, 10**6), 700)],
        "mixed": lambda: [rng.choice([-40.0, 0.0, 5.5, rng.randint(-10**12, 10**12) / 1e6 / 86_400.0]) for _ in range(301)],
        "one": lambda: [1.5],
    }[kind]
    values = {"Late": make(), "On-time": make()}
    frame = gaps(spark, [(o, v) for o, vs in values.items() for v in vs] + [("Late", None), ("never", None)])
    got = {(r.delivery_outcome, r.share): (r.n, r.gap_days) for r in quantiles.gap_quantiles(frame, (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert len(got) == 10
    for outcome, vs in values.items():
        ordered = sorted(vs)
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            place = share * (len(vs) - 1)
            low, high = ordered[int(place)], ordered[min(int(place) + 1, len(vs) - 1)]
            n, value = got[outcome, share]
            assert n == len(vs) and value == pytest.approx(low + (high - low) * (place - int(place)), abs=1e-12)
    assert got["Late", 0.5][1] == pytest.approx(statistics.median(values["Late"]), abs=1e-12)


def test_gap_quantiles_of_nothing(spark):
    assert quantiles.gap_quantiles(gaps(spark, [])).collect() == []


def test_order_statistics_with_few_bins(spark):
    rng = random.Random(1)
    values = [rng.randint(-(2**50), 2**50) for _ in range(200)] + [7] * 50
    frame = spark.createDataFrame([("g", v) for v in values], "group string, value long")
    ranks = list(range(0, 250, 31))
    found = quantiles.order_statistics(frame, {"g": ranks}, {"g": (min(values), max(values))}, bins=64)
    assert [found["g", r] for r in ranks] == [sorted(values)[r] for r in ranks]


def weight(key, replicate, seed=42):
    digest = hashlib.md5(f"{key}:{replicate // 4}:{seed}".encode()).hexdigest()
    return sum(int(digest[8 * (replicate % 4) :][:8], 16) >= b for b in bootstrap.BOUNDS)


def test_weights_are_poisson(spark):
    drawn = Counter(weight(i, r) for i in range(400) for r in range(50))
    for count, share in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert drawn[count] / 20_000 == pytest.approx(share, abs=0.012)


def test_score_difference_against_direct_replicates(spark):
    rng = random.Random(4)
    rows = [(i, rng.random() < 0.2, rng.choice([1, 2, 3, 4, 5, None])) for i in range(300)]
    frame = spark.createDataFrame(rows, "review_id long, is_late boolean, review_score int")

    def difference(times):
        sums = Counter()
        for i, late, score in rows:
            if score is not None:
                sums["n", late] += times(i)
                sums["s", late] += times(i) * score
        return sums["s", False] / sums["n", False] - sums["s", True] / sums["n", True]

    values = sorted(difference(lambda i: weight(i, r)) for r in range(bootstrap.REPLICATES))
    for parts in (1, 5):
        r = bootstrap.score_difference(frame.repartition(parts)).first()
        assert r.n == sum(s is not None for _, _, s in rows)
        assert (r.difference, r.low, r.high) == pytest.approx((difference(lambda i: 1), values[round(199 * 0.025)], values[round(199 * 0.975)]))
        assert r.low < r.difference < r.high


def test_intervals_of_one_side_and_of_nothing(spark):
    frame = spark.createDataFrame([(i, False, 3) for i in range(9)], "review_id long, is_late boolean, review_score int")
    assert tuple(bootstrap.score_difference(frame).first()) == (9, None, None, None)
    assert tuple(bootstrap.mean_interval(frame.limit(0), "review_id", F.col("is_late")).first()) == (0, None, None, None)
    assert tuple(bootstrap.mean_interval(frame, "review_id", F.col("is_late")).first()) == (9, 0.0, 0.0, 0.0)


def test_replicates_repeat_rows_per_hash_and_join_nothing(spark):
    """A fourth of the rows of all replicates are made, and no rows are joined without a key."""
    frame = spark.createDataFrame([(i, i % 3 == 0, i % 5 + 1) for i in range(90)], "review_id long, is_late boolean, review_score int")
    result = bootstrap.score_difference(frame)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "conv(" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "NestedLoop" not in bootstrap.mean_interval(frame, "review_id", F.col("is_late"))._jdf.queryExecution().executedPlan().toString()


def test_replicates_compare_bytes_and_add_two_sums_a_replicate(spark):
    """Per replicate of a hash the rows drawn and their scores are added up, side by side; digests are not cut as strings."""
    frame = spark.createDataFrame([(i, i % 3 == 0, i % 5 + 1) for i in range(90)], "review_id long, is_late boolean, review_score int")
    plan = bootstrap.score_difference(frame)._jdf.queryExecution().executedPlan().toString()
    assert "unhex(md5(" in plan
    assert max(line.count("partial_sum(") for line in plan.splitlines()) == 8


def test_rows_drawn_with_missing_and_repeated_keys(spark):
    keys = [None, None, "", "a:b", "x" * 70, "x" * 70, "é"]
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "id string, v long")
    got = {r.replicate: (r.drawn, r.v) for r in bootstrap.replicate_sums(frame, "id", {"v": F.col("v")}, replicates=10).collect()}

    def times(key, replicate):
        text = ("" if key is None else f"{key}:") + f"{replicate // 4}:42"
        part = hashlib.md5(text.encode()).hexdigest()[8 * (replicate % 4) :][:8]
        return sum(int(part, 16) >= b for b in bootstrap.BOUNDS)

    want = {r: (sum(times(k, r) for k in keys), sum(times(k, r) * i for i, k in enumerate(keys))) for r in range(10)}
    assert got == {r: w for r, w in want.items() if w[0]}


def test_replicate_sums_by_group_and_missing_measures(spark):
    rows = [(i, "b" if i % 4 else None, None if i % 7 == 0 else i) for i in range(12)]
    frame = spark.createDataFrame(rows, "id long, side string, v long")
    got = {(r.replicate, r.side): r.v for r in bootstrap.replicate_sums(frame, "id", {"v": F.col("v")}, by=("side",), replicates=10).collect()}
    want, drawn = {}, set()
    for i, side, v in rows:
        for r in range(10):
            if times := weight(i, r):
                drawn.add((r, side))
                if v is not None:
                    want[r, side] = want.get((r, side), 0) + times * v
    assert got == {k: want.get(k) for k in drawn}


def test_quotas_by_largest_remainder(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), (None, 1)], "stratum string, size long")
    quota = lambda n: {r.stratum: r.quota for r in sampling.quotas(sizes, n).collect()}
    assert quota(10) == {"a": 5, "b": 3, "c": 2, None: 0}
    assert quota(7) == {"a": 4, "b": 2, "c": 1, None: 0}
    assert quota(101) == quota(500) == {"a": 50, "b": 30, "c": 20, None: 1}
    assert quota(0) == {"a": 0, "b": 0, "c": 0, None: 0}


def test_a_stratum_with_nearly_all_rows_and_small_ones(spark):
    rows = [(i, "hot") for i in range(9_900)] + [(i, f"s{i % 5}") for i in range(9_900, 9_995)] + [(i, None) for i in range(9_995, 10_000)]
    frame = spark.createDataFrame(rows, "id long, kind string").repartition(6)
    got = sampling.stratified_sample(frame, "id", "kind", 1_000, 7).collect()
    assert len(got) == 1_000 and Counter(r.kind for r in got)["hot"] == 990
    order = lambda i: (hashlib.md5(f"{i}:7".encode()).hexdigest(), i)
    for kind in ("hot", "s1"):
        mine = sorted((i for i, k in rows if k == kind), key=order)
        quota = next(r.quota for r in got if r.kind == kind)
        assert sorted((r["rank"], r.id) for r in got if r.kind == kind) == list(enumerate(mine[:quota], 1))
    again = sampling.stratified_sample(frame.repartition(2), "id", "kind", 1_000, 7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sampling.stratified_sample(frame.limit(0), "id", "kind", 10, 7).collect() == []

