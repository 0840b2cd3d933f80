import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from punctual.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def xxhash64(value, seed=42):
    return xxhash.xxh64_intdigest(value, seed=seed)


def brute(text):
    """(hash, position) by Spark's hash of word hashes, every window looked at on its own."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return []
    codes = [xxhash64(w.encode()) for w in words]
    grams = []
    for i in range(max(len(codes) - fp.GRAM + 1, 1)):
        seed = 42
        for code in codes[i : i + fp.GRAM]:
            seed = xxhash64(code.to_bytes(8, "little"), seed)
        grams.append(seed & 0xFFFFFFFF)
    chosen = []
    for i in range(max(len(grams) - fp.WINDOW + 1, 1)):
        window = range(i, min(i + fp.WINDOW, len(grams)))
        least = min(grams[j] for j in window)
        at = max(j for j in window if grams[j] == least)
        if not chosen or (least, at) not in chosen:
            chosen.append((least, at))
    return chosen


def shown(picks):
    return " ".join(f"{h:x}@{p}" for h, p in picks)


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """The contract by plain Python: rows (doc_id, text) with distinct (doc_id, text) in the order."""
    marks = {r: signed(xxhash64((r[1] or "").encode())) for r in rows}
    order = sorted({(r[0], r[1] or ""): marks[r] for r in rows}.items(), key=lambda kv: (kv[0][0] is None, -(kv[0][0] or 0), -kv[1]))
    order = [key for key, _ in order]
    out = {}
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, after = brute(text), brute(edited), brute(following)
        out[doc_id, text] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(changed), likeness(own, changed), likeness(own, after),
        )
    return sorted(((r[0], *out[r[0], r[1] or ""]) for r in rows), key=repr)


def test_query_equals_brute_force(documents):
    some = documents.where(F.length("text") < 4000)
    rows = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in fp.edited_fingerprints(some.repartition(5)).collect()), key=repr)
    assert got == expected(rows)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in fp.edited_fingerprints(odd).collect()), key=repr) == expected(rows)
    assert fp.edited_fingerprints(nothing).count() == 0
    one = odd.where("doc_id = 4")
    assert fp.edited_fingerprints(one).first().near_next == 1.0


def test_a_shared_run_of_the_guaranteed_length_is_found(spark):
    shared = " ".join(f"s{i}" for i in range(fp.GRAM + fp.WINDOW - 1))
    texts = [(1, " ".join(f"a{i}" for i in range(40)) + f" {shared} tail"), (2, f"b c {shared} " + " ".join(f"d{i}" for i in range(30)))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = (set(r.h) for r in fp.fingerprints(frame).select(fp.hashes(F.col("picks")).alias("h")).collect())
    assert a & b


def test_ties_choose_the_rightmost_gram(spark):
    frame = spark.createDataFrame([(1, "same " * 20)], "doc_id long, text string")
    row = fp.fingerprints(frame).select(fp.as_text(F.col("picks")).alias("t")).first()
    assert [int(p.split("@")[1]) for p in row.t.split()] == list(range(fp.WINDOW - 1, 16))


def test_order_crosses_ranges(spark):
    frame = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")).repartition(7)
    got = {r.doc_id: r.edited_sha256 for r in fp.edited_fingerprints(frame).collect()}
    for i in (0, 1, 500, 999):
        text, following = f"text number {i}", f"text number {(i - 1) % 1000}"
        cut = len(text) // 3
        assert got[i] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()
