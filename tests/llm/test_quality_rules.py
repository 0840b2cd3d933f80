import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import quality_rules as Q
from punctual.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
        len(words) < 20 or 100 * len(inside) > 30 * len(words),
    )


def char_class(c):
    if c in "#*$%&|<>":
        return "symbol"
    if c in ".,;:?'\"-()":
        return "sentence"
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if "0" <= c <= "9":
        return "digit"
    if c < "\x7f":
        return "other" if c > " " else None
    return None if c < "\x80" else "latin" if c < "ʀ" else "foreign"


def histogram(texts):
    return Counter(k for t in texts for k in map(char_class, t) if k)


def distance(p, q):
    keys = set(p) | set(q)
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    part = lambda x: sum(x[k] * math.log2(x[k] / m[k]) for k in x if x[k] > 0)
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()} if total else {}


def brute(rows):
    """Verdicts of (doc_id, text, lang) rows from plain counts."""
    good = [(t or "", lang) for _, t, lang in rows if lang is not None and not base(t)[5]]
    references = {}
    for lang in {lang for _, lang in good}:
        texts = [t for t, x in good if x == lang]
        words = Counter(w for t in texts for w in WORD.findall(t))
        total = sum(words.values())
        common = {w: n / total for w, n in words.items() if n / total >= Q.COMMON_SHARE}
        references[lang] = (shares(histogram(texts)), common)
    out = []
    for doc_id, text, _ in rows:
        counts = base(text)
        chars, words = histogram([text or ""]), Counter(WORD.findall(text or ""))
        near = not references
        for classes, common in references.values():
            by_char = distance(shares(chars), classes)
            mine = {w: words[w] / max(counts[0], 1) for w in common if words[w]}
            by_word = distance(mine | {None: 1 - sum(mine.values())}, common | {None: max(0.0, 1 - sum(common.values()))})
            near |= (sum(chars.values()) < Q.MIN_CHARS or by_char <= Q.MAX_CHAR_DISTANCE) and (
                counts[0] < Q.MIN_HISTOGRAM_WORDS or by_word <= Q.MAX_WORD_DISTANCE
            )
        out.append((doc_id, *counts, not counts[5] and near))
    return sorted(out, key=repr)


def judged(frame):
    return sorted((tuple(r)[:8] for r in Q.judged(frame).collect()), key=repr)


def test_query_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    want = brute(rows)
    assert sorted((tuple(r)[:8] for r in queries()["op9_divergence_rules"](spark, FOLDER).collect()), key=repr) == want
    assert any(not r[6] and not r[7] for r in want)


def test_references_do_not_depend_on_blocks(spark, documents, monkeypatch):
    want = judged(documents.coalesce(1))
    monkeypatch.setattr(Q, "BLOCK_WORDS", 500)
    assert judged(documents.repartition(7)) == want


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert judged(odd) == brute(rows)
    assert judged(nothing) == []
    kept = Q.kept_documents(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in brute(rows) if r[7]), key=repr)


def test_without_references_the_base_rules_decide(odd):
    rows = Q.judged(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.kept == (not r.base_failed) and r.language is None for r in rows)


def test_foreign_distributions_are_rejected(spark):
    rng = np.random.default_rng(1)
    common, rare = ["the", "of", "and", "a"], [f"w{i:03d}x" for i in range(800)]
    write = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    texts = [write(200) for _ in range(60)]
    noise = " ".join(f"{a}###" for a in rng.choice(rare, 120))
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, noise])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in Q.judged(frame).collect()}
    assert all(got[i] for i in range(60)) and not got[60]


@pytest.mark.parametrize("p, q", [([1, 0], [0, 1]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.7, 0.3])])
def test_distance(p, q):
    want = distance(dict(enumerate(p)), dict(enumerate(q)))
    assert Q._distance(np.array([p]), np.array(q))[0] == pytest.approx(want)


def test_query_equals_sql(spark):
    import duckdb

    from punctual.llm.queries import oracle_sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(oracle_sql()["op9_divergence_rules"]).fetchall()
    assert sorted(map(tuple, queries()["op9_divergence_rules"](spark, FOLDER).collect())) == sorted(want)
