import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from punctual.llm import periodic_runs as P
from punctual.llm import queries
from punctual.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch by every period; the smallest period of a stretch counts."""
    found = {}
    n = len(words)
    for q in range(1, n // P.TURNS + 1):
        begin = 0
        while begin < n - q:
            if words[begin] != words[begin + q]:
                begin += 1
                continue
            end = begin
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end + q - begin
            if length >= max(P.LEAST, P.TURNS * q):
                found.setdefault((begin, length), q)
            begin = end
    return sorted((b, length, q) for (b, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for b, length, q in runs for i in range(b + q, b + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(texts, ids=None, rewrite=None):
    out = []
    t = W.texts(pa.array(texts, pa.string()))
    for block in W.blocks(t):
        mine = (ids or [0] * len(texts))[block.first : block.last]
        out += [(f.runs, P._joined(t.data, block, f.kept).decode()) for f in P.block_runs(block, mine, rewrite)]
    return out


@st.composite
def repetitive(draw):
    """Random words with repeated stretches of all period lengths, nested and overlapping."""
    words = []
    for _ in range(draw(st.integers(1, 5))):
        letters = draw(st.integers(1, 6))
        unit = draw(st.lists(st.integers(0, letters), min_size=1, max_size=draw(st.sampled_from([3, 14, 40, 90]))))
        times = draw(st.integers(1, 6))
        words += [f"w{x}" for x in (unit * times)[: len(unit) * times - draw(st.integers(0, len(unit) - 1))]]
    return words


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4))
def test_runs_are_those_of_brute_force(many):
    for words, (runs, collapsed) in zip(many, found_in([" ".join(w) for w in many]), strict=True):
        assert runs == brute_runs(words)
        assert collapsed == brute_collapsed(words, runs)


@pytest.mark.parametrize("period", [*range(1, 75), 91, 136, 137, 204, 306, 307, 459, 688, 1032])
def test_every_period_at_every_scale_is_found(period):
    rng = np.random.default_rng(period)
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 1 << 40, n)]
    unit = noise(period)
    length = max(P.LEAST, P.TURNS * period)
    words = noise(17) + (unit * (length // period + 1))[:length] + noise(23)
    assert found_in([" ".join(words)])[0][0] == [(17, length, period)]
    short = noise(17) + (unit * (length // period + 1))[: length - 1] + noise(23)
    assert found_in([" ".join(short)])[0][0] == []


def test_a_text_of_many_blocks_and_its_neighbours():
    rng = np.random.default_rng(5)
    unit = [f"u{x}" for x in rng.integers(0, 1 << 40, 3_000)]
    many = [f"x{x}" for x in rng.integers(0, 1 << 40, 60_000)] + unit * 4 + ["tail"]
    texts = ["a b c", " ".join(many), None, " ".join(unit * 3)]
    assert len(texts[1]) > W.BLOCK_BYTES + 400_000
    found = found_in(texts)
    assert [f[0] for f in found] == [[], [(60_000, 12_000, 3_000)], [], [(0, 9_000, 3_000)]]
    assert found[1][1] == " ".join([*many[:60_000], *unit, "tail"])


def test_symmetric_words_do_not_deceive_the_hashes():
    """Words in the order of Thue and Morse defeat hashes modulo a power of two."""
    words = ["ab"[bin(i).count("1") % 2] for i in range(6_000)]
    assert found_in([" ".join(words)])[0][0] == brute_runs(words)


def test_wrong_seeds_are_scanned_directly(monkeypatch):
    """Should hashes of different ranges be equal, the lags concerned are compared word by word."""
    unit = [f"u{i}" for i in range(30)]
    words = [f"a{i}" for i in range(40)] + unit * 4 + [f"b{i}" for i in range(40)]
    right = P.Hashes.extend
    monkeypatch.setattr(P.Hashes, "extend", lambda self, a, b: tuple(x + 7 for x in right(self, a, b)))
    assert found_in([" ".join(words)])[0][0] == [(40, 120, 30)]


def planted_words(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted_words(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    lines = "".join(f"{b},{length},{q}\n" for b, length, q in runs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, milli, digest(lines), digest(brute_collapsed(words, runs)))


def query(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.periodic_words(spark, str(tmp_path)).collect()), key=repr)


def test_odd_rows(spark, odd, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [expected(*r) for r in rows if r[0] != 2**60]
    got = query(spark, odd, tmp_path)
    assert [r for r in got if r[0] != 2**60] == sorted(want, key=repr)
    long = next(r for r in got if r[0] == 2**60)
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000)


def test_repeated_texts_of_many_rows(spark, tmp_path):
    rows = [(i, f"a b c d e {'same words again and ' * 12}{i % 7}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("best", F.lit("x"))
    assert query(spark, frame, tmp_path) == sorted([expected(*r) for r in rows], key=repr)


def test_an_empty_table(spark, nothing, tmp_path):
    assert query(spark, nothing, tmp_path) == []


def test_whole_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = queries.periodic_words(spark, folder)
    cursor = con.execute(queries.oracle_sql()["op12_periodic_runs"])
    assert result.columns == [d[0] for d in cursor.description]
    got = sorted(map(tuple, result.collect()))
    assert got == sorted(cursor.fetchall()) and sum(r[1] for r in got) > 0


def test_no_shuffle(spark, documents):
    plan = P.periodic_runs(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
