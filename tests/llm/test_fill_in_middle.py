import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from punctual.llm import fill_in_middle as M
from punctual.llm import queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ALPHABET = ["a", "Zz", "word", "<", ">", "P", "S", "M", "<P", "S>", " ", "\n", "é", "日", "\U0001f600", "9", "\x00"]


def expected(doc_id, text):
    """The contract, on whole strings."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def made(doc_id, text):
    """Facts and output pieces of one row, as the tasks emit them."""
    first, *records = M.pieces(0, [(doc_id, text.encode())])
    assert first.section == M.FACTS and [r[:4] for r in records] == [(0, 0, 0, i) for i in range(len(records))]
    assert all(len(r.content) <= M.PIECE_BYTES + 3 for r in records)
    return first.facts[:5], [r.content for r in records]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 500), st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_pieces_make_the_output_and_the_output_the_text(doc_id, text):
    facts, parts = made(doc_id, text)
    output = b"".join(parts)
    assert (*facts, output.decode()) == expected(doc_id, text)
    assert M.restored_text(output, facts[2]) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=25).map("".join), st.integers(1, 4))
def test_marks_are_found_across_the_borders_of_pieces(doc_id, text, size):
    facts, parts = made(doc_id, text)
    output = b"".join(parts)
    parser, found = M.Sections(facts[2]), []
    for i in range(0, len(output), size):
        found += parser.feed(output[i : i + size])
    found += parser.rest()
    assert b"".join(p for _, p in sorted(found, key=lambda x: x[0])) == text.encode()


def test_long_units_and_long_texts_are_cut_into_small_pieces():
    for text in ("x" * 1_000_000, "é" * 200_000, "ab " * 200_000, "日x" * 100_000):
        for doc_id in range(12):
            facts, parts = made(doc_id, text)
            assert (*facts, b"".join(parts).decode()) == expected(doc_id, text)
            assert all(p.decode() is not None for p in parts)


def whole(frame):
    return Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in frame.collect())


def digests_of(rows):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return Counter((*e[:5], digest(e[5]), digest(text or "")) for e, text in ((expected(*r), r[1]) for r in rows))


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert whole(M.outputs(odd)) == Counter(expected(*r) for r in rows)
    assert Counter(map(tuple, M.digests(odd).collect())) == digests_of(rows)


def test_any_number_of_partitions_gives_the_same_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for partitions in (1, 7):
        assert Counter(map(tuple, M.digests(odd.repartition(5), partitions).collect())) == digests_of(rows)


def test_a_hot_row_is_spread_over_the_partitions(spark):
    frame = spark.range(3_000).select(F.lit(5).alias("doc_id"), F.lit("one and the same text").alias("text")).repartition(4)
    places = M.sorted_pieces(frame, 8).select("part", "ordinal", F.spark_partition_id().alias("at")).distinct()
    sizes = [r["count"] for r in places.groupBy("at").count().collect()]
    assert sum(sizes) == 3_000 and max(sizes) < 2 * 3_000 / 8


def test_an_empty_table(spark, nothing):
    assert M.outputs(nothing).collect() == [] and M.digests(nothing).collect() == []


def test_the_text_is_shuffled_once(documents):
    plan = M.digests(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_documents_larger_than_a_batch_stream_through(spark, monkeypatch):
    rows = [(i, "ab, " * 3_000_000) for i in range(2)] + [(7, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, M.digests(frame, 1).collect())) == digests_of(rows)


def test_whole_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = queries.fim_documents(spark, folder)
    cursor = con.execute(queries.oracle_sql()["op13_fill_in_middle"])
    assert result.columns == [d[0] for d in cursor.description]
    got = sorted(map(tuple, result.collect()))
    assert got == sorted(cursor.fetchall()) and {r[2] for r in got} == {"plain", "psm", "spm"}
