import hashlib
import json

import pytest
from pyspark.sql import functions as F

from punctual.functions import theme_json
from punctual.operators import labelling, sampling
from punctual.plans import jobs
from punctual.sources.cache import ResultCache
from punctual.catalogue import stand_ins


def parse(spark, *answers):
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    parsed = frame.select("i", theme_json.parse_labels(F.col("answer")).alias("p")).orderBy("i").collect()
    return [None if r.p is None else [tuple(x) for x in r.p] for r in parsed]


ROW = {"review_id": "1", "theme": "other", "severity": "low"}
ROWS = json.dumps([ROW, {"review_id": "2", "theme": "late_delivery"}])
PARSED = [("1", "other", "low"), ("2", "late_delivery", None)]


def test_parse_accepts_plain_fenced_and_wrapped_arrays(spark):
    assert parse(
        spark, ROWS, f"```json\n{ROWS}\n```", f"```\n{ROWS}```", f"Sure:\n{ROWS}\nDone.", f"  {ROWS}\n", "[]"
    ) == [PARSED] * 5 + [[]]


def test_parse_rejects_everything_else(spark):
    assert parse(spark, "no json", ROWS[:-1], json.dumps(ROW), json.dumps({"rows": [ROW]}), "", None) == [None] * 6


def test_themes_are_clamped_and_severities_kept(spark):
    answer = json.dumps(
        [
            {"review_id": "1", "theme": "surprise", "severity": "extreme"},
            {"review_id": "2", "severity": "low"},
            {"review_id": 3, "theme": "poor_quality", "severity": "high"},
        ]
    )
    rows = labelling.explode_labels(spark.createDataFrame([(answer,)], "answer string")).collect()
    assert [tuple(r) for r in rows] == [
        ("1", "other", "extreme"),
        ("2", "other", "low"),
        ("3", "poor_quality", "high"),
    ]


def population(spark, n, partitions=3):
    frame = spark.range(n).select(
        F.col("id").alias("review_id"), F.concat(F.lit("text "), "id").alias("review_comment_message")
    )
    return frame.repartition(partitions)


def expected_order(n, seed):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [None, 0, 7, 500])
def test_sample_is_the_head_of_the_hash_order(spark, n):
    rows = sampling.sample_ranked(population(spark, 300), "review_id", n, seed=42).collect()
    got = [r.review_id for r in sorted(rows, key=lambda r: r["rank"])]
    want = expected_order(300, 42)
    assert got == (want if n is None else want[:n])
    assert sorted(r["rank"] for r in rows) == list(range(1, len(got) + 1))


def test_buckets_beyond_the_sample_are_dropped_before_the_shuffle(spark):
    """The exchange of the ranked rows lies above the join with the kept buckets."""
    sampled = sampling.sample_ranked(population(spark, 2000), "review_id", 20, 7)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(_bucket")
    assert "BroadcastHashJoin [_bucket" in plan[exchange:]
    assert "_offset" in plan[exchange:] and "< 20)" in plan[exchange:]


def test_any_bucket_width_gives_the_same_sample(spark):
    runs = {
        tuple(sorted((r["rank"], r.review_id) for r in sampling.sample_ranked(population(spark, 200, 5), "review_id", 60, 7, digits).collect()))
        for digits in (1, 2, 4)
    }
    assert len(runs) == 1


def test_batches_are_full_but_the_last(spark):
    sample = sampling.sample_ranked(population(spark, 60), "review_id", 55, 42)
    blocks = labelling.review_blocks(sample, batch_size=25).orderBy("batch_id").collect()
    assert [b.n_reviews for b in blocks] == [25, 25, 5]
    want = [f"- review_id={i}: text {i}" for i in expected_order(60, 42)[:55]]
    assert "\n".join(b.reviews for b in blocks).split("\n") == want


def test_prompt_text_limit(spark):
    frame = spark.createDataFrame([(1, "é" * 500)], "review_id int, review_comment_message string")
    sample = sampling.sample_ranked(frame, "review_id", 5, 1)
    short, whole = (labelling.review_blocks(sample, max_chars=m).first().reviews for m in (400, None))
    assert short == "- review_id=1: " + "é" * 400 and whole == "- review_id=1: " + "é" * 500


def flaky_labeler(folder, failures):
    """Answers garbage for the first ``failures`` calls of a prompt, then labels it."""
    rule = stand_ins.id_labeler()

    def answer(prompt):
        import hashlib
        import os

        path = os.path.join(folder, hashlib.md5(prompt.encode()).hexdigest())
        with open(path, "a") as calls:
            calls.write("x")
        if os.path.getsize(path) <= failures:
            return "sorry, [no labels"
        return rule(prompt)

    return answer


def negative_features(spark, n):
    return population(spark, n).withColumns({"is_negative": F.lit(True), "has_text": F.col("review_id") % 5 != 0})


def test_broken_answers_are_asked_again_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = ResultCache(spark, str(tmp_path / "cache"))
    labels = labelling.build_themes(negative_features(spark, 50), flaky_labeler(str(calls), 1), cache, n_sample=30)
    rows = labels.collect()
    assert sorted(int(r.review_id) for r in rows) == sorted(
        [i for i in expected_order(50, 42) if i % 5][:30]
    )
    assert {len(p.read_text()) for p in calls.iterdir()} == {2}
    assert {r.theme for r in rows} <= set(theme_json.THEMES)


def test_reviews_without_a_label_fail_the_job_or_are_reported(spark, tmp_path):
    features = negative_features(spark, 5)
    cache = ResultCache(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="4 reviews of 'themes' got no label"):
        labelling.build_themes(features, lambda prompt: "[]", cache)
    done = labelling.labelled_themes(features, lambda prompt: "sorry", ResultCache(spark, str(tmp_path / "b")))
    assert tuple(done.coverage().first()) == (4, 0, 4, 0)
    assert sorted(r.review_id for r in done.missing.collect()) == ["1", "2", "3", "4"]


def test_invented_repeated_and_unnamed_ids(spark, tmp_path):
    def careless(prompt):
        import json

        row = {"theme": "other", "severity": "low"}
        return json.dumps([{"review_id": "1", **row}, {"review_id": "1", **row}, {"review_id": "77", **row}, row])

    done = labelling.labelled_themes(negative_features(spark, 5), careless, ResultCache(spark, str(tmp_path)))
    assert [r.review_id for r in done.labels.collect()] == ["1"]
    # Two attempts: the second prompt no longer holds review 1, so its labels for it are foreign too.
    assert tuple(done.coverage().first()) == (4, 1, 3, 6)


def test_number_of_tasks_follows_the_number_of_prompts(spark):
    prompts = spark.range(100).select(
        F.col("id").alias("batch_id"), F.array(F.col("id").cast("string")).alias("review_ids"), F.lit("p").alias("prompt")
    )
    for tasks in (1, 7, 50):
        assert labelling.ask_labeler(prompts, stand_ins.id_labeler(), tasks).rdd.getNumPartitions() == tasks


def test_a_run_that_breaks_off_is_continued_without_asking_twice(spark, tmp_path):
    """The first attempt is stored, the second breaks; the next call asks only what is missing."""
    calls = tmp_path / "calls"
    calls.mkdir()
    rule, folder = stand_ins.drifting_labeler(1), str(calls)

    def labeler(broken):
        def answer(prompt):
            import json
            import os
            import re
            import tempfile

            ids = re.findall(r"^- review_id=(\d+): ", prompt, re.MULTILINE)
            with os.fdopen(tempfile.mkstemp(dir=folder)[0], "w") as f:
                f.write(" ".join(ids))
            second = all(int(i) % 3 == 0 for i in ids)
            if broken and second:
                raise RuntimeError("the service is down")
            rows = json.loads(rule(prompt))
            return json.dumps(rows if second else [r for r in rows if int(r["review_id"]) % 3])

        return answer

    features = negative_features(spark, 60)
    cache = ResultCache(spark, str(tmp_path / "cache"))
    with pytest.raises(Exception, match="the service is down"):
        labelling.build_themes(features, labeler(True), cache)
    for p in calls.iterdir():
        p.write_text("")
    labels = labelling.build_themes(features, labeler(False), cache)
    assert sorted(int(r.review_id) for r in labels.collect()) == [i for i in range(60) if i % 5]
    asked = " ".join(p.read_text() for p in calls.iterdir()).split()
    assert sorted(map(int, asked)) == [i for i in range(60) if i % 5 and i % 3 == 0]


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "review_id string, theme string, severity string")


def test_stability_counts_each_review_once(spark):
    a = labels_frame(spark, [("1", "other", "low"), ("1", "other", "low"), ("2", "other", "low"), ("9", "other", "low")])
    b = labels_frame(spark, [("1", "other", "low"), ("2", "late_delivery", "low"), ("2", "never_arrived", "low")])
    assert tuple(labelling.stability(a, b).first()) == (2, 0.5)


def test_only_unlabelled_reviews_are_asked_again(spark, tmp_path):
    features = negative_features(spark, 40)
    cache = ResultCache(spark, str(tmp_path / "cache"))
    labelling.build_themes(features, stand_ins.id_labeler(), cache, n_sample=10)
    calls = tmp_path / "calls"
    calls.mkdir()
    labels = labelling.build_themes(features, flaky_labeler(str(calls), 0), cache, n_sample=20)
    ids = [int(r.review_id) for r in labels.collect()]
    assert sorted(ids) == sorted([i for i in expected_order(40, 42) if i % 5][:20])
    assert sum(len(p.read_text()) for p in calls.iterdir()) == 1


def test_theming_job_loads_the_stored_run_and_compares_a_fresh_one(spark, tmp_path):
    features = negative_features(spark, 40).withColumn("is_late", F.col("review_id") % 2 == 0)
    cache = ResultCache(spark, str(tmp_path))
    result, chart = jobs.theming_job(features, cache, stand_ins.id_labeler(), n_sample=20)
    summary = result.summary.first()
    assert (summary.n, summary.stability_pct) == (20, 100.0)
    assert sum(json.loads(summary.freq).values()) == 20
    assert sum(r.n for r in chart.collect()) == 20
