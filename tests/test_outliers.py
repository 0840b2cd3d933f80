import math
import random

import pytest
from pyspark.sql import functions as F

from punctual.functions import special
from punctual.operators import outliers


def frame(spark, rows):
    return spark.createDataFrame([(f"c{i:03d}", n, k) for i, (n, k) in enumerate(rows)], "customer_city string, n long, late long")


def likelihood(rows, a, b):
    lg = math.lgamma
    return sum(lg(k + a) - lg(a) + lg(n - k + b) - lg(b) - lg(n + a + b) + lg(a + b) for n, k in rows)


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1))


def test_gamma_functions(spark):
    values = [0.01, 0.5, 1.0, 3.7, 9.99, 10.0, 250.0, 1e6]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", F.expr(special.log_gamma("x")).alias("g"), F.expr(special.digamma_step("x", "5D")).alias("d"), F.expr(special.trigamma_step("x", "5D")).alias("t")
    )
    for r in rows.collect():
        assert math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-12, abs_tol=1e-11)
        assert math.isclose(r.d, sum(1 / (r.x + i) for i in range(5)), rel_tol=1e-9)
        assert math.isclose(r.t, -sum(1 / (r.x + i) ** 2 for i in range(5)), rel_tol=1e-8)


def test_binomial_tails_against_direct_sums(spark):
    cases = [(k, n, p) for n in (1, 2, 7, 40) for k in range(-1, n + 2) for p in (0.0, 1e-4, 0.13, 0.5, 0.97, 1.0)] + [(130, 1000, 0.1), (420, 1000, 0.5)]
    rows = spark.createDataFrame(cases, "k long, n long, p double").select(
        "k", "n", "p", F.expr(special.binomial_at_least("k", "n", "p")).alias("up"), F.expr(special.binomial_at_most("k", "n", "p")).alias("down")
    )
    for r in rows.collect():
        assert math.isclose(r.up, tail(r.k, r.n, r.p), rel_tol=1e-9, abs_tol=1e-300), r
        assert math.isclose(r.down, tail(r.n - r.k, r.n, 1 - r.p), rel_tol=1e-9, abs_tol=1e-300), r


def test_beta_quantiles_come_back(spark):
    cases = [(0.4, 0.7), (1.0, 1.0), (40.0, 3.0), (3.0, 40.0), (0.5, 300.0), (1e4, 9e4), (1.0, 7.0)]
    for p in (0.025, 0.5, 0.975):
        rows = spark.createDataFrame(cases, "a double, b double").withColumn("q", F.expr(special.beta_quantile(p, "a", "b")))
        for r in rows.withColumn("back", F.expr(special.incomplete_beta("q", "a", "b"))).collect():
            assert abs(r.back - p) < 1e-9, r
    uniform = spark.createDataFrame([(1.0, 1.0)], "a double, b double").select(F.expr(special.beta_quantile(0.25, "a", "b")).alias("q")).first()
    assert abs(uniform.q - 0.25) < 1e-12


def spread_groups(seed, groups=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        n = rng.choice([0, 1, 2, 20, 90, 400])
        rate = rng.betavariate(3, 17)
        rows.append((n, sum(rng.random() < rate for _ in range(n))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_the_prior_is_the_likeliest_one(spark, seed):
    rows = spread_groups(seed)
    prior = outliers.fit_prior(frame(spark, rows))
    best = likelihood(rows, *prior)
    mean, strength = prior.alpha / sum(prior), sum(prior)
    # No prior of a fine grid around it, nor one far away, is likelier.
    grid = [(m, s) for m in [mean * f for f in (0.97, 0.999, 1, 1.001, 1.03)] for s in [strength * f for f in (0.9, 0.99, 1, 1.01, 1.1)]]
    grid += [(m / 50, s) for m in range(1, 50) for s in (0.1, 1, 5, 20, 100, 1000, 1e5)]
    assert all(likelihood(rows, m * s, (1 - m) * s) <= best + 1e-7 for m, s in grid)


def test_the_prior_of_alike_small_and_no_groups(spark):
    alike = outliers.fit_prior(frame(spark, [(100, 10)] * 40))
    assert sum(alike) == pytest.approx(outliers.STRONGEST) and alike.alpha / sum(alike) == pytest.approx(0.1, abs=1e-4)
    ones = outliers.fit_prior(frame(spark, [(1, 1)] * 5 + [(1, 0)] * 15))
    assert ones.alpha / sum(ones) == pytest.approx(0.25, abs=1e-6) and math.isfinite(sum(ones))
    assert outliers.fit_prior(frame(spark, [])) == outliers.fit_prior(frame(spark, [(0, 0)])) == (1.0, 1.0)
    extreme = outliers.fit_prior(frame(spark, [(50, 0)] * 10))
    assert 0 < extreme.alpha / sum(extreme) < 0.01


def test_shrunk_rates(spark):
    rows = spread_groups(5)
    prior = outliers.Prior(3.0, 17.0)
    out = {r.customer_city: r for r in outliers.shrunk_rates(frame(spark, rows), prior).collect()}
    for i, (n, k) in enumerate(rows):
        r = out[f"c{i:03d}"]
        assert r.shrunk_rate == pytest.approx((k + 3) / (n + 20)) and r.low < r.shrunk_rate < r.high
        assert r.late_rate is None if n == 0 else r.late_rate == pytest.approx(k / n)
    wide = [out[f"c{i:03d}"] for i, (n, _) in enumerate(rows) if n == 0]
    assert len({(r.low, r.high) for r in wide}) == 1
    assert outliers.shrunk_rates(frame(spark, [])).collect() == []


def test_the_prior_does_not_depend_on_the_partitioning(spark):
    rows = frame(spark, spread_groups(9))
    assert outliers.fit_prior(rows.repartition(1)) == outliers.fit_prior(rows.repartition(7))


def brute_funnel(rows):
    rows = [(i, n, k) for i, (n, k) in enumerate(rows) if n]
    p = sum(k for _, _, k in rows) / sum(n for _, n, _ in rows)
    values = {i: min(1.0, 2 * min(tail(k, n, p), tail(n - k, n, 1 - p))) for i, n, k in rows}
    out = {}
    for i, n, k in rows:
        low = next(c for c in range(n + 1) if tail(n - c, n, 1 - p) > 0.025)
        high = max(c for c in range(n + 1) if tail(c, n, p) > 0.025)
        rank = sum(v <= values[i] * (1 + 1e-12) for v in values.values())
        q = min(min(1.0, v * len(values) / sum(u <= v * (1 + 1e-12) for u in values.values())) for v in values.values() if v >= values[i] * (1 - 1e-12))
        out[f"c{i:03d}"] = (values[i], rank, q, low / n, high / n, "no" if q > 0.05 else "high" if k / n > p else "low")
    return out


@pytest.mark.parametrize("rows", [spread_groups(4), [(1, 0), (1, 1), (1, 0), (0, 0)], [(300, 30)] * 30 + [(300, 90), (300, 90), (300, 1)], [(10, 0), (20, 0)], [(7, 7)]])
def test_funnel_against_direct_sums(spark, rows):
    want = brute_funnel(rows)
    got = {r.customer_city: r for r in outliers.funnel(frame(spark, rows)).collect()}
    assert set(got) == set(want)
    for name, (p, rank, q, low, high, outlier) in want.items():
        r = got[name]
        assert r.p_value == pytest.approx(p, rel=1e-8) and r.rank == rank and r.q_value == pytest.approx(q, rel=1e-8)
        assert (r.low_rate, r.high_rate, r.outlier) == (pytest.approx(low), pytest.approx(high), outlier)


def test_funnel_of_nothing(spark):
    assert outliers.funnel(frame(spark, [])).collect() == []


def test_group_rates(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("a", None), (None, True)], "customer_city string, is_late boolean")
    assert [tuple(r) for r in outliers.group_rates(rows).collect()] == [("a", 3, 1)]
