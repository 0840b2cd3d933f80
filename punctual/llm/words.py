"""Words and their hashes, computed on the bytes of whole Arrow text columns.

A word is a run of bytes other than space and the control characters 9 to 13, which is
``[^\\x20\\x09-\\x0D]+`` on the decoded text. Nothing here loops over words in Python: the kernels
work on blocks of whole documents. A text beyond the block size is worked off in pieces that end at
white space, so the memory needed grows with a text's words, not with a multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text in one block.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_random = np.random.default_rng(20_011)
_BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class Kind(NamedTuple):
    """Which bytes separate words, and the code under which each other byte is hashed."""

    space: np.ndarray
    codes: np.ndarray


#: Words as they stand between white space.
PLAIN = Kind(SPACE, _BYTE_CODES)


def _terms() -> Kind:
    """Runs of ASCII letters, digits and bytes beyond ASCII, with ASCII upper case as lower case."""
    space = np.ones(256, dtype=bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        space[ord(low) : ord(high) + 1] = False
    space[128:] = False
    codes = _BYTE_CODES.copy()
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return Kind(space, codes)


TERMS = _terms()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP = _powers(_BASE, 4 * BLOCK_BYTES + 1)
_DOWN = _powers(_INVERSE, 4 * BLOCK_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit with probability one half."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts(NamedTuple):
    """The bytes of a text column and where each row's text begins and ends; null is empty."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Words(NamedTuple):
    """The words of documents ``first`` to ``last`` (exclusive): row, byte range in ``data``, hash."""

    first: int
    last: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    heads: tuple[np.ndarray, ...] = ()


def texts(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        column, wide = column.cast(pa.string()), np.int32
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start, end = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        end[null] = start[null]
    return Texts(data, start, end)


def _spans(data: np.ndarray, breaks: np.ndarray, kind: Kind, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Begin, end and hash of the words of ``data``, and the hash of each asked-for prefix (the word's own where it is shorter).

    A word never crosses one of the ``breaks``. A prefix is so many code points.
    """
    space = kind.space[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (_powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(kind.codes[data] * up[: len(data)], out=total[1:])
    heads = []
    if prefixes:
        points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = np.searchsorted(points, begin)
        for n in prefixes:
            stop = np.minimum(points[np.minimum(at + n, len(points) - 1)], end)
            heads.append(mix((total[stop] - total[begin]) * down[begin] + np.uint64(n) * (stop < end)))
    return begin, end, mix((total[end] - total[begin]) * down[begin]), *heads


def _pieces(data: np.ndarray, start: int, end: int, kind: Kind) -> Iterator[tuple[int, int]]:
    """Cut one long text between words into pieces of about a block."""
    while start < end:
        stop = min(start + BLOCK_BYTES, end)
        while stop < end and not kind.space[data[stop]]:
            gap = np.flatnonzero(kind.space[data[stop : min(stop + BLOCK_BYTES, end)]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + BLOCK_BYTES, end)
        yield start, stop
        start = stop


def blocks(t: Texts, kind: Kind = PLAIN, prefixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """The words of all rows, block by block; every block holds whole rows."""
    n = len(t.start)
    none = np.zeros(0, np.int64)
    first = 0
    while first < n:
        last = int(np.searchsorted(t.end, t.start[first] + BLOCK_BYTES, "right"))
        if last <= first:
            last = first + 1
            found = [_spans(none.astype(np.uint8), none, kind, prefixes)]
            for lo, hi in _pieces(t.data, int(t.start[first]), int(t.end[first]), kind):
                begin, end, *codes = _spans(t.data[lo:hi], none, kind, prefixes)
                found.append((begin + lo, end + lo, *codes))
            begin, end, *codes = (np.concatenate(c) for c in zip(*found, strict=True))
            row = np.full(len(begin), first, dtype=np.int64)
        else:
            lo, hi = int(t.start[first]), int(t.end[last - 1])
            bounds = t.start[first:last] - lo
            begin, end, *codes = _spans(t.data[lo:hi], bounds, kind, prefixes)
            row = first + np.searchsorted(bounds, begin, "right") - 1
            begin, end = begin + lo, end + lo
        yield Words(first, last, row, begin, end, codes[0], tuple(codes[1:]))
        first = last


def counts(words: Words, mask: np.ndarray | None = None) -> np.ndarray:
    """Words (or those in ``mask``) of every row of the block."""
    row = words.row if mask is None else words.row[mask]
    return np.bincount(row - words.first, minlength=words.last - words.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``k`` words; a row of fewer words has one run of them all."""
    n = counts(words)
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    total = int(runs.sum())
    row = np.repeat(np.arange(len(n)), runs)
    at = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(runs)])[:-1], runs) + starts[row]
    left = np.minimum(n[row], k)
    code = np.zeros(total, dtype=np.uint64)
    for i in range(k):
        inside = left > i
        term = words.hash[np.minimum(at + i, max(len(words.hash) - 1, 0))] if len(words.hash) else code
        code = np.where(inside, code * np.uint64(0xD1342543DE82EF95) + term, code)
    return row + words.first, mix(code ^ left.astype(np.uint64))


def decode(data: np.ndarray, start: int, end: int) -> str:
    return data[start:end].tobytes().decode("utf-8", "replace")


def range_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges ``low`` to ``high`` (exclusive)."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[high] - total[low]
