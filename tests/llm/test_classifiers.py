import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import quality_score as Q
from punctual.llm import toxicity as T
from punctual.llm import words as W
from punctual.llm.queries import queries
from punctual.llm.sampling import labelled_documents, labelled_sample

FOLDER = "/root/testdata/sf0.1"


def test_samples_are_bounded_and_ordered_by_a_hash(spark, odd):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 10)] + [(9, 1), (9, 0), (None, 1), (4, None)], "doc_id long, toxic int"
    )
    rows = labelled_sample(odd, labels, "toxic", 100).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(i, i % 2) for i in (1, 2, 3, 4, 5, 6, 7)]
    assert all(r.text is not None for r in rows)
    assert {r.doc_id for r in labelled_sample(odd, labels, "toxic", 3).collect()} <= set(range(1, 9))
    none = labelled_sample(odd, labels, "toxic", 100, F.col("doc_id") > 5).collect()
    assert sorted(r.doc_id for r in none) == [6, 7]


# Quality


def loss(w, d):
    return np.log1p(np.exp(-d @ w)).mean() + Q.RIDGE / 2 * w @ w


def test_pair_weights_minimise_the_logistic_loss():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 1, (40, 3)), rng.normal(0, 1, (30, 3))
    w = Q.fit_pairs(good, bad, partners=8)
    pairs = np.random.default_rng(7)
    d = good[pairs.integers(40, size=240)] - bad[np.repeat(np.arange(30), 8)]
    best = loss(w, d)
    assert all(loss(w + step, d) >= best for step in rng.normal(0, 0.01, (50, 3)))


def test_features_see_bad_passages():
    import pyarrow as pa

    texts = ["a plain text of ordinary words. " * 10, "SHOUTING WORDS!! " * 40, "noise*** in### words$$$ " * 20, "same " * 100, "a | b | c | " * 30, "", None]
    t = W.texts(pa.array(texts))
    x = np.concatenate([Q.features(t, b) for b in W.blocks(t)])
    column = dict(zip(Q.FEATURES, x.T))
    assert x.shape == (7, len(Q.FEATURES)) and np.isfinite(x).all()
    assert column["worst_upper"][1] == 1 and column["worst_symbol"][2] == 1 and column["worst_repeats"][3] > 0.9
    assert column["worst_bare"][4] == 0.5 and column["worst_distinct"][3] < 0.1
    assert not x[5:].any() and not column["worst_symbol"][0]


def test_quality_held_out(spark):
    rows = queries()["op1_bradley_terry_quality"](spark, FOLDER).toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    met = rows[rows.held_out].merge(spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas(), on="doc_id")
    assert (met.predicted == met.quality).mean() > 0.97
    good, bad = met[met.quality == 1].score.to_numpy(), met[met.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.99


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(6, 1), (4, 0), (9, 0), (1, 0), (7, 1)], "doc_id long, quality int")
    model = Q.train(odd, labels)
    rows = Q.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[7]) == 1
    assert Q.scored(nothing, model).count() == 0
    untrained = Q.train(odd, labels.where("quality = 1"))
    assert {r.score for r in Q.scored(odd, untrained).collect()} == {0.5}
    assert Q.train(nothing, labels).threshold == 0.0


# Toxicity


def likelihood(weights, cuts, rows, columns, grade):
    z = np.bincount(rows, weights=weights[columns], minlength=len(grade))
    above = np.concatenate([np.ones((len(grade), 1)), 1 / (1 + np.exp(-(z[:, None] - cuts))), np.zeros((len(grade), 1))], axis=1)
    i = np.arange(len(grade))
    return -np.log(above[i, grade] - above[i, grade + 1]).mean() + T.RIDGE / 20 * weights @ weights


def test_cumulative_link_fit_is_a_minimum():
    rng = np.random.default_rng(4)
    x = rng.random((300, 4)) < 0.4
    z = x @ np.array([2.0, 1.0, 0.0, -1.0]) + rng.logistic(size=300)
    grade = (z > 0.5).astype(int) + (z > 2)
    rows, columns = np.nonzero(x)
    weights, cuts = T.fit_cumulative(rows, columns, 4, grade)
    assert cuts[0] < cuts[1] and weights[0] > weights[1] > weights[3]
    best = likelihood(weights, cuts, rows, columns, grade)
    for _ in range(40):
        assert likelihood(weights + rng.normal(0, 0.05, 4), cuts + rng.normal(0, 0.02, 2), rows, columns, grade) > best - 1e-4


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    rows = T.graded(docs, T.train(docs, labels.where(half))).withColumnRenamed("toxic", "found").join(labels.where(~half), "doc_id").toPandas()
    assert rows[rows.toxic == 1].found.mean() > 0.75 and rows[rows.toxic == 0].found.mean() < 0.02
    assert rows[rows.toxic == 1].severity.mean() > 20 * rows[rows.toxic == 0].severity.mean()
    assert rows.severity.between(0, 2).all() and set(rows.grade) == {0, 1, 2}


def test_toxicity_of_odd_rows(spark, odd, nothing):
    texts = [(100 + i, f"you {'idiot' if i % 2 else 'friend'} number{i} said something") for i in range(80)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = T.train(frame, labels)
    got = {r.doc_id: r for r in T.graded(frame, model).collect()}
    assert all(got[100 + i].toxic == i % 2 for i in range(80))
    rows = T.graded(odd, model).collect()
    assert len(rows) == odd.count() and not any(r.toxic for r in rows)
    assert T.graded(nothing, model).count() == 0
    blank = T.train(nothing, labels)
    assert not any(r.toxic for r in T.graded(frame, blank).collect())


@pytest.mark.parametrize("word", ["IDIOT!", "(idiot)", "idiots", "x\nidiot\ty"])
def test_toxic_terms_in_other_shapes(spark, word):
    texts = [(i, f"you {'idiot' if i % 2 else 'friend'} a{i} b{i} c{i}") for i in range(80)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model = T.train(frame, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    shown = spark.createDataFrame([(1, f"some words {word} more words " + "calm " * 500)], "doc_id long, text string")
    assert T.graded(shown, model).first().toxic == 1


def test_every_label_takes_part(spark):
    """More labels than the former bound of 20,000: all of them are joined, and all pairs of them fit the weights."""
    n = 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", "'word' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    assert labelled_documents(docs, labels, "quality").count() == n


def test_all_pairs_minimise_the_loss_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 1, (60, 3)), rng.normal(0, 1, (45, 3))
    rows = spark.createDataFrame([(1, x.tolist()) for x in good] + [(0, x.tolist()) for x in bad], "label int, x array<double>")
    mean, spread = np.zeros(3), np.ones(3)
    w = Q.fit_all_pairs(rows, mean, spread)
    assert (Q.fit_all_pairs(rows.repartition(5), mean, spread) == w).all()
    d = (good[:, None] - bad).reshape(-1, 3)
    assert all(loss(w + step, d) > loss(w, d) for step in rng.normal(0, 0.02, (50, 3)))
    counts = Q._moments(rows, mean, spread, w)[0].sum(axis=0)
    scores = np.sort(np.rint(np.concatenate([good, bad]) * Q.STEPS) / Q.STEPS @ w)
    assert Q._order_statistics(rows, (mean, spread, w), counts, [0, 45, 104]) == pytest.approx([scores[0], scores[45], scores[104]], abs=1e-4)
