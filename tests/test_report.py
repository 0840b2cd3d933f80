import pytest

from punctual.catalogue import stand_ins
from punctual.operators.labelling import build_themes
from punctual.plans import jobs, medallion
from punctual.plans.report import analyse, store
from punctual.sources.cache import ResultCache
from punctual.sources.star_schema import star_schema_bronze

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bronze(spark):
    return star_schema_bronze(spark, FOLDER)


def unplugged(*_):
    raise AssertionError("a plain run must not call the model or the labeler")


def test_plain_run_uses_stored_model_results(spark, bronze, tmp_path):
    cache = ResultCache(spark, str(tmp_path))
    lexicon = stand_ins.lexicon(spark)
    plugged = analyse(
        bronze, cache, stand_ins.star_model(), lexicon, stand_ins.id_labeler(), min_orders=1
    )
    first = {name: table.collect() for name, table in store(plugged, cache).items()}
    second = analyse(bronze, cache, unplugged, lexicon, unplugged, min_orders=1)
    again = {name: table.collect() for name, table in second.items()}
    assert set(first) == set(again)
    for name, rows in again.items():
        assert rows and sorted(rows, key=repr) == sorted(first[name], key=repr), name
    assert again["grain_check"][0].is_unique
    assert len(again["theme_counts"]) == 8


def test_stability_runs_the_labeler_twice(spark, bronze, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rule, folder = stand_ins.id_labeler(), str(calls)

    def counting(prompt):
        import os
        import tempfile

        os.close(tempfile.mkstemp(dir=folder)[0])
        return rule(prompt)

    features = medallion.build_features(bronze)
    result = jobs.theme_stability(features, ResultCache(spark, str(tmp_path / "c")), counting).first()
    n = build_themes(features, rule, ResultCache(spark, str(tmp_path / "d"))).count()
    assert (result.n_both, result.stability) == (n, 1.0)
    assert len(list(calls.iterdir())) == 2 * -(-n // 25)
