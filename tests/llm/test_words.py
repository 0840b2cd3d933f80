import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from punctual.llm import words as W

TEXT = st.text(alphabet=st.sampled_from(list("ab \n\t\x0b\x1f é日😀.,'")), max_size=40)


def found(texts, kind=W.PLAIN, prefixes=()):
    t = W.texts(pa.array(texts, pa.string()))
    out, hashes, heads = [[] for _ in texts], {}, {}
    for block in W.blocks(t, kind, prefixes):
        for i, (row, lo, hi, code) in enumerate(zip(block.row, block.start, block.end, block.hash)):
            word = W.decode(t.data, lo, hi)
            out[row].append(word)
            assert hashes.setdefault(word if kind is W.PLAIN else word.lower(), code) == code
            for n, head in zip(prefixes, block.heads):
                assert heads.setdefault((n, word[:n], len(word) > n), head[i]) == head[i]
    return out, hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got, hashes = found(texts, prefixes=(2, 3))
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_long_texts_are_cut_between_words(monkeypatch):
    texts = ["ab " * 50_000 + "end", "q" * 300_000, "ab end"]
    whole, _ = found(texts)
    monkeypatch.setattr(W, "BLOCK_BYTES", 1_000)
    cut, hashes = found(texts)
    assert cut == whole and len(hashes) == 3


def test_terms_fold_case_and_drop_punctuation():
    got, hashes = found(["Trash, trash! TRASH; (été) x1"], W.TERMS)
    assert got == [["Trash", "trash", "TRASH", "été", "x1"]] and len(hashes) == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6), st.integers(1, 4))
def test_shingles(rows, k):
    t = W.texts(pa.array([" ".join(r) for r in rows]))
    seen = {}
    got = [[] for _ in rows]
    for block in W.blocks(t):
        row, code = W.shingles(block, k)
        for r, c in zip(row, code):
            got[r].append(c)
    for words, codes in zip(rows, got):
        runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
        assert len(runs) == len(codes)
        for run, code in zip(runs, codes):
            assert seen.setdefault(run, code) == code
    assert len(set(seen.values())) == len(seen)


def test_range_sums():
    assert W.range_sums(np.array([1, 2, 3]), np.array([0, 1, 1]), np.array([3, 1, 2])).tolist() == [6, 0, 2]
