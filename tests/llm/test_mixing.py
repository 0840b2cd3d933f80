import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from punctual.llm import mixing
from punctual.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def brute_targets(sizes):
    """Shares by weight; sources above three times their size are held there and the excess is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        left = total - sum(held.values())
        open_ = [s for s in names if s not in held]
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] >= 3 * sizes[s]]
        if not over:
            return held | target
        held |= {s: 3 * sizes[s] for s in over}
        if len(held) == len(names):
            return held


def test_targets_by_hand(spark):
    sizes = {"a": 10, "b": 4000, "c": 7, "d": 1, "e": 900, "é": 3, None: 50}
    frame = spark.createDataFrame([("s" + s if s is not None else "n", n) for s, n in sizes.items()], "_source string, _size long")
    got = {r._source: r.target for r in mixing.source_targets(frame).collect()}
    want = brute_targets(sizes)
    assert {("s" + s if s is not None else "n"): pytest.approx(t) for s, t in want.items()} == got


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(oracle_sql()["op7_source_mix"]).fetchall()
    got = queries()["op7_source_mix"](spark, FOLDER).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_small_blocks_equal_sql(spark, monkeypatch):
    """Many slots a source, dropped and appended ones among them."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(oracle_sql()["op7_source_mix"].replace("4096", "16")).fetchall()
    got = queries()["op7_source_mix"](spark, FOLDER).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({r.first_slot for r in got}) > 20


def test_every_block_of_the_schedule_has_one_slot(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    placed, schedule = mixing.plan(documents)
    quota = {r._source: r.quota for r in placed.select("_source", "quota").distinct().collect()}
    rows = schedule.collect()
    slots = {(r._source, r.block): r.position for r in rows}
    assert len(set(slots.values())) == len(slots) == sum(math.ceil(q / 64) for q in quota.values())
    for (source, block), _ in slots.items():
        words = sum(r.words for r in rows if (r._source, r.block) == (source, block))
        assert words == min(64, quota[source] - 64 * block)
    # Low discrepancy: after any number of slots each source has had about its share.
    order = [s for (s, _), _ in sorted(slots.items(), key=lambda kv: kv[1])]
    n = Counter(order)
    for cut in range(50, len(order), 97):
        seen = Counter(order[:cut])
        assert all(abs(seen[s] - cut * n[s] / len(order)) < 8 for s in n)


def test_odd_rows(odd, nothing):
    rows = mixing.mixture(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.size for r in rows if r.doc_id is not None}[2**60] == 30_000
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by_source = {}
    for r in odd.select("doc_id", "source", "text").collect():
        by_source[r.source] = by_source.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(by_source)
    got = {r.source_size: r.target for r in rows}
    assert {by_source[s]: pytest.approx(t) for s, t in want.items()} == got
    assert sum(r.taken for r in rows) == pytest.approx(sum(by_source.values()), abs=3)
    assert mixing.mixture(nothing).count() == 0 == mixing.mixed_documents(nothing).count()


def test_reruns_agree_whatever_the_partitions(documents):
    runs = [sorted(map(tuple, mixing.mixture(documents.repartition(n)).collect())) for n in (1, 9)]
    assert runs[0] == runs[1]


def test_mixed_documents_hold_the_words_taken(odd):
    words = F.regexp_count("text", F.lit(mixing.WORD))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    per_id = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    taken = {r.doc_id: r.n for r in mixing.mixture(odd).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    assert per_id == taken
    whole = {r.text for r in odd.collect()}
    cut = [r for r in mixed.collect() if r.text not in whole]
    assert len(cut) <= 5 and all(r.n_chars == len(r.text) for r in cut)


def test_mixed_documents_come_in_the_order_of_the_slots(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    _, schedule = mixing.plan(documents)
    order = {}
    for r in schedule.collect():
        if r.first_word == 0:
            order.setdefault(r.position, []).append((r._round, r._begin, r.doc_id))
    want = [i for position in sorted(order) for _, _, i in sorted(order[position])]
    assert [r.doc_id for r in mixing.mixed_documents(documents).select("doc_id").collect()] == want


def test_equal_rows_and_texts_of_one_id_are_taken_as_often_as_they_come(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e f", "s"), (None, "g", "s"), (None, "h i", None), (2, None, None), (3, "", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = [sorted(map(tuple, mixing.mixed_documents(frame.repartition(n)).collect()), key=repr) for n in (1, 4)]
    assert mixed[0] == mixed[1]
    assert Counter(r[2] for r in mixed[0] for _ in r[1].split()) == Counter({"s": 9, None: 3})


def test_no_python_in_the_plans(spark):
    for name in ("op5_winnowing", "op7_source_mix"):
        plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_points_are_those_of_the_golden_ratio():
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    phi = (Decimal(5).sqrt() - 1) / 2
    for i in (0, 1, 12_345, (1 << 20) + 7, (1 << 33) + 99):
        got = ((i >> 20) * mixing._PHI_HIGH + (i % (1 << 20)) * mixing._PHI + 0.5 * mixing._PHI) % 1.0
        assert abs(got - float((phi * (i + Decimal("0.5"))) % 1)) < 1e-6
