import hashlib
import math
import re
import time
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from punctual.llm import personal_data as P
from punctual.llm import queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARDS = ["4111111111111111", "5500005555555559", "4485-2757-4230-8327", "6011 0009 9013 9424"]
PARTS = ["+1 (743) 555-3824", "a.b@x.de", "1.2.3.4", *CARDS, " ", ".", "-", "(", ")", "+", "@", "7", "99", "a", "x.y", "é", "\n", "999.1.1.1", "%", "٣", ",", "0000255.1.1.1"]


def brute_rules(text):
    """The contract, pattern by pattern over the whole text."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((P.KINDS.index(kind), *m.span()))
    return out


@pytest.fixture(scope="module")
def field():
    """Trained as the operator trains it, on the clusters of another table than the tests look at."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id % 2 = 0").fetchall()
    found = {(t[a:b], t[max(a - 2, 0) : a], t[b : b + 2]) for (t,) in rows for a, b in P.clusters(t or "")}
    return P.fit(P.examples(sorted(found)[:600]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_rules_are_those_of_the_patterns(text):
    assert P.rule_spans(text)[0] == brute_rules(text)
    assert P.all_spans(text, P.EMPTY) == (brute_rules(text), brute_rules(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@aZ%é\n", max_size=60))
def test_rules_on_noise(text):
    assert P.all_spans(text, P.EMPTY)[0] == brute_rules(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_added_spans_overlap_nothing(field, text):
    base, spans = P.all_spans(text, field)
    assert set(base) <= set(spans) and spans == sorted(spans)
    added = sorted(s[1:] for s in set(spans) - set(base))
    assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))
    assert all(b <= x or y <= a for x, y in added for _, a, b in base)


def segmentations(n, found, at=0):
    """Every way to divide ``n`` tokens into candidates and single tokens outside."""
    if at == n:
        yield []
        return
    for rest in segmentations(n, found, at + 1):
        yield rest
    for c in found:
        if c.first == at:
            for rest in segmentations(n, found, c.last):
                yield [c, *rest]


def score_of(n, chosen, field):
    total, label, at = 0.0, P.NONE, 0
    for c in [*chosen, None]:
        stop = n if c is None else c.first
        for _ in range(at, stop):
            total += field.moves[label][P.NONE]
            label = P.NONE
        if c is not None:
            total += field.moves[label][c.kind] + sum(field.weights.get(f, 0.0) for f in c.features)
            label, at = c.kind, c.last
    return total + field.moves[label][P.NONE]


CLUSTERS = ["1.2.3.4 5.6.7.8", "+1 (743) 555-3824", "4111111111111111 +1 743", "a@b.c.d", "4111-1111-1111-1111 4", "(743) 555-3824 1"]


@pytest.mark.parametrize("text", CLUSTERS)
def test_the_best_segmentation_is_found(field, text):
    borders, found = P.candidates(text, "n ", " t")
    n = len(borders) - 1
    best = max(score_of(n, s, field) for s in segmentations(n, found))
    by_place = {(c.kind, c.first, c.last): c for c in found}
    chosen = [by_place[s] for s in P.best_segments(P.Cluster(text, "n ", " t"), field)]
    assert found and math.isclose(score_of(n, chosen, field), best, abs_tol=1e-9)


def test_training_ends_where_likelihood_and_ridge_balance(monkeypatch):
    """Expected features, counted over all segmentations, meet the observed ones at the optimum."""
    monkeypatch.setattr(P, "STEPS", 3_000)
    monkeypatch.setattr(P, "RIDGE", 0.05)
    monkeypatch.setattr(P, "RATE", 0.02)
    labelled = [P.Example(t, "n ", " t", tuple(sorted(P.rule_spans(t)[0], key=lambda s: s[1:]))) for t in ("1.2.3.4 5.6.7.8", "a@b.c", "4111111111111112")]
    field = P.fit(labelled)
    difference = Counter()
    for e in labelled:
        borders, found = P.candidates(e.text, e.left, e.right)
        n = len(borders) - 1
        ways = list(segmentations(n, found))
        scores = [score_of(n, w, field) for w in ways]
        top = max(scores)
        total = sum(math.exp(s - top) for s in scores)
        for way, s in zip(ways, scores, strict=True):
            for c in way:
                for f in c.features:
                    difference[f] += math.exp(s - top) / total
        for c in found:
            if (c.kind, borders[c.first], borders[c.last]) in e.spans:
                for f in c.features:
                    difference[f] -= 1
    for f, w in field.weights.items():
        assert abs(difference[f] / 3 + 0.05 * w) < 2e-3, f


def test_neighbours_that_spoil_each_other_are_told_apart(field):
    text = "call +1 (663) 555-6869 4465758382889437 4465758382889437 now"
    assert P.rule_spans(text)[0] == []
    assert [(P.KINDS[k], text[a:b]) for k, a, b in P.all_spans(text, field)[1]] == [
        ("card", "4465758382889437"), ("card", "4465758382889437"), ("phone", "+1 (663) 555-6869"),
    ]
    assert ("phone", "(743) 555-3824") in [(P.KINDS[k], t) for k, t in [(k, "(743) 555-3824") for k, _, _ in P.all_spans("call (743) 555-3824 now", field)[1]]]


@pytest.mark.parametrize(
    "text", ["on 2024-01-15 10:20", "from 1990-2000", "978-3-16-148410-0", "pi 3.14159265358979", "id 1234567890123 x", '"36a36974748794293dd8a"', "1 2 3 4 5 6 7", "300.1.1.1"]
)
def test_other_numbers_are_left_alone(field, text):
    assert P.all_spans(text, field)[1] == []


def test_held_out_joined_values_are_found(field):
    """Pairs of values from documents the field was not trained on, joined so that the rules lose them."""
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id % 2 = 1").fetchall()
    values = sorted({t[a:b] for (t,) in rows for k, a, b in P.rule_spans(t or "")[0] if k in (P.CARD, P.PHONE)})[:200]
    right = 0
    for one, two in zip(values, reversed(values)):
        text = f"word {one} {two} word"
        spans = P.all_spans(text, field)[1]
        right += sorted(s[1:] for s in spans) == [(5, 5 + len(one)), (6 + len(one), 6 + len(one) + len(two))]
    assert right >= 0.95 * len(values)


def test_clean_documents_get_no_more_than_the_rules_find(field):
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id % 2 = 1").fetchall()
    clean = [t for (t,) in rows if t and not P.rule_spans(t)[1]]
    assert len(clean) > 4_000 and sum(len(s) - len(b) for b, s in (P.all_spans(t, field) for t in clean)) == 0


@pytest.mark.parametrize("text", ["1 " * 40_000, "(" * 200_000, "+1" * 100_000, "a@" * 50_000, "x" * 500_000 + "@", "1.2.3.4." * 20_000, "9" * 300_000, "+ " * 100_000, "a.b@c." * 30_000])
def test_time_grows_with_the_length(field, text):
    begin = time.monotonic()
    P.all_spans(text, field)
    assert time.monotonic() - begin < 40


def row_of(doc_id, text, field):
    base, spans = brute_rules(text or ""), P.all_spans(text or "", field)[1]
    listed = lambda x: ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in x)
    return (doc_id, *[sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))


def test_whole_query_against_brute_force(spark, documents):
    field = P.train(documents)
    got = Counter(map(tuple, queries.personal_spans(spark, "/root/testdata/sf0.001").collect()))
    assert got == Counter(row_of(r.doc_id, r.text, field) for r in documents.collect())
    assert P.train(documents.repartition(5)) == field


def test_odd_rows_and_empty_tables(spark, odd, nothing, tmp_path):
    assert P.train(nothing) == P.train(odd) == P.EMPTY
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, queries.personal_spans(spark, str(tmp_path)).collect()))
    assert got == Counter(row_of(r.doc_id, r.text, P.EMPTY) for r in odd.collect())
    assert P.personal_data(nothing, P.EMPTY).collect() == [] and P.masked(nothing, P.EMPTY).collect() == []


def test_masked_texts(spark, field):
    frame = spark.createDataFrame([(1, "to a.b@x.de, +1 (743) 555-3824é"), (2, None), (3, "nothing")], "doc_id long, text string")
    assert [r.text for r in P.masked(frame, field).orderBy("doc_id").collect()] == ["to <EMAIL>, <PHONE>é", None, "nothing"]
    assert P.masked_text("abcdef", [(0, 1, 4), (3, 2, 5)]) == "a<EMAIL>f"
