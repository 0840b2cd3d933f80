import os
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from punctual.llm import language, mixing, neardup, packing, quality_rules
from punctual.llm.storage import stored

FOLDER = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_near_duplicates import brute_classes  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], FOLDER), name))
    return docs


def rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_stages_keep_the_columns_and_rows_of_documents(steps):
    for before, after in zip(steps[:3], steps[1:4]):
        assert after.columns == steps[0].columns and after.dtypes == steps[0].dtypes
        assert rows(after) <= rows(before) and after.count() > 0
    assert steps[4].dtypes == steps[0].dtypes
    assert "sequence_id" in steps[5].columns


def test_rules_and_language_decide_alone(steps):
    raw, ruled, named = steps[:3]
    kept = {r.doc_id for r in quality_rules.judged(raw).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == kept and ruled.count() < raw.count()
    found = language.identify(ruled, language.train(ruled)).collect()
    assert {r.doc_id for r in named.collect()} == {r.doc_id for r in found if r.score >= language.MIN_SCORE and r.lang_pred != "und"}


def test_one_of_each_class_stays(steps):
    named, single = steps[2:4]
    classes, _ = brute_classes({r.doc_id: r.text for r in named.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    assert neardup.near_duplicates(single).where("class_size > 1").count() == 0


def test_mix_and_pieces_hold_all_words(steps):
    single, mixed, pieces = steps[3:6]
    taken = mixing.mixture(single).agg({"taken": "sum"}).first()[0]
    words = mixed.select(mixing.word_count(mixed.text).alias("n")).agg({"n": "sum"}).first()[0]
    assert words == taken
    ids = packing.word_ids(packing.public_tokenizer())
    tokens = sum(len(ids(r.text.encode())) // 4 + 1 for r in mixed.collect())
    assert pieces.agg({"length": "sum"}).first()[0] == tokens


def test_run_is_the_stages_in_order(spark, steps):
    drop = ["sequence_id"]
    got = entry_point.queries()["pipeline"](spark, FOLDER).drop(*drop)
    assert rows(got) == rows(steps[5].drop(*drop))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry_point.oracle_sql()


def test_empty_documents(spark, steps):
    docs = steps[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0
