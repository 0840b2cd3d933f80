import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from punctual.llm import packing

TOKENIZER = Tokenizer.from_file(packing.public_tokenizer())
ALPHABET = list("abS'st \t\n\r\x0b\x0c\x1c\x85  1²ß.İΣςé́日본") + ["<|endoftext|>", "'s", "'re", " 's", "<|EndOfText|>"]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14))
def test_ids_by_word_are_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    got = np.frombuffer(packing.word_ids(packing.public_tokenizer())(text.encode()), "<u4").tolist()
    assert got == ids_of(text)[:-1]


def test_a_full_memory_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.WordIds(packing.public_tokenizer())
    for text in ("one two three", "extraordinarily four five six", "one seven eight two extraordinarily"):
        assert np.frombuffer(words(text.encode()), "<u4").tolist() == ids_of(text)[:-1]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = packing.WordIds(path)
    text = "Two  Words\n"
    assert not words.by_word
    assert np.frombuffer(words(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@given(st.integers(0, 50_000))
def test_pieces_are_powers_of_two(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 4096 for x in lengths)
    assert lengths == sorted(lengths, reverse=True) and len(set(lengths) - {4096}) == len([x for x in lengths if x < 4096])


def rebuilt(pieces):
    """Ids of every document row from its pieces."""
    out = Counter()
    by_doc = {}
    for r in pieces.collect():
        by_doc.setdefault((r.doc_id, r.doc_tokens, r.sequence_id >> 33), []).append(r)
    assert len({r.sequence_id for rows in by_doc.values() for r in rows}) == sum(map(len, by_doc.values()))
    for (doc_id, tokens, _), rows in by_doc.items():
        at = b""
        for r in sorted(rows, key=lambda r: r.sequence_id):
            assert r.length == len(r.ids) // 4 == r.bucket and r.offset == 0
            at = b"" if r.start == 0 else at
            assert r.start == len(at) // 4
            at += bytes(r.ids)
            if len(at) // 4 == tokens:
                out[doc_id, at] += 1
    return out


def test_documents_are_rebuilt_from_their_pieces(documents, odd):
    for frame in (documents, odd):
        want = Counter((r.doc_id, np.array(ids_of(r.text), "<u4").tobytes()) for r in frame.select("doc_id", "text").collect())
        assert rebuilt(packing.pack(frame)) == want


def test_small_sequences_and_batches(odd, nothing):
    pieces = packing.pack(odd, capacity=8, end_id=7)
    assert pieces.agg(F.max("length")).first()[0] == 8
    loads = packing.batches(pieces, tokens=64, parts=2).groupBy("bucket", "part", "batch").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in loads) <= 64
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, capacity=100)


def test_query_reports_checksums(spark):
    from punctual.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    rows = queries()["op4_power_of_two_packing"](spark, folder).where("doc_id = 0").collect()
    text = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 0").first().text
    ids = np.array(ids_of(text), "<u4")
    assert {(r.start, r.length, r.ids_crc32) for r in rows} == {
        (r.start, r.length, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in rows
    }
    assert sum(r.length for r in rows) == len(ids) == rows[0].doc_tokens
