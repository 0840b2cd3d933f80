"""Periodic runs of words: minimizers at several scales seed them, hashes of ranges extend them.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``TURNS`` periods
long, that no neighbouring word extends. Periods up to ``DIRECT`` are found by comparing every word
with the one so many places on. For longer ones a scale covers the periods in (k', k], where k is
1.5 k': the hashes of all runs of k words are taken, and of every w consecutive ones the least. As
k >= q, equal hashes inside a run lie a multiple of q apart, and w = 2 (k' + 1) - k + 1 leaves room
for a window and its copy one period on in any run of three periods: its least hash is chosen at
both places. So two neighbouring choices of one hash lie exactly q apart in every run; such pairs are
extended to both sides by halving over hashes of ranges, and the outcome is compared word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import prepare_workers

LEAST = 24
TURNS = 3
#: Periods found by direct comparison.
DIRECT = 12
#: Words joined at a time when a text is put together.
JOINED = 1 << 16

_PRIMES = (2147483629, 2147483587)
_BASES = (1000003 * 17, 998244353)
_POWERS: dict[int, np.ndarray] = {}


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo ``prime``, kept for the next block."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, dtype=np.uint64)
        while len(known) < n:
            step = np.uint64(pow(base, len(known), prime))
            known = np.concatenate([known, known * step % np.uint64(prime)])
        _POWERS[base] = known
    return known[:n]


class Hashes:
    """Hashes of all ranges of a sequence, modulo two primes."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.sums, self.up, self.down = [], [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            p = np.uint64(prime)
            up = _power_table(base, prime, self.n + 1)
            total = np.zeros(self.n + 1, dtype=np.uint64)
            # Up to 2^32 summands below 2^31.
            np.cumsum(x % p * up[: self.n] % p, out=total[1:])
            self.sums.append(total % p)
            self.up.append(up)
            self.down.append(_power_table(pow(base, -1, prime), prime, self.n + 1))

    def grams(self, k: int) -> np.ndarray:
        """One 62-bit hash, mixed, for every run of ``k`` elements."""
        both = []
        for prime, total, down in zip(_PRIMES, self.sums, self.down, strict=True):
            p = np.uint64(prime)
            both.append((total[k:] + p - total[:-k]) * down[: self.n - k + 1] % p)
        return W.mix((both[0] << np.uint64(31)) | both[1])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges of ``length`` at ``a`` and ``b`` (a < b) are equal."""
        equal = np.ones(len(a), dtype=bool)
        for prime, total, up in zip(_PRIMES, self.sums, self.up, strict=True):
            p = np.uint64(prime)
            left = (total[a + length] + p - total[a]) % p * up[b - a] % p
            equal &= left == (total[b + length] + p - total[b]) % p
        return equal

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the elements at and after ``a`` and ``b``, and those before them, agree."""
        steps = 1 << max(self.n.bit_length() - 1, 0)
        ahead, behind = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        while steps:
            more = ahead + steps
            fits = b + more <= self.n
            ok = np.flatnonzero(fits)
            ok = ok[self.same(a[ok], b[ok], more[ok])]
            ahead[ok] = more[ok]
            more = behind + steps
            ok = np.flatnonzero(more <= a)
            ok = ok[self.same(a[ok] - more[ok], b[ok] - more[ok], more[ok])]
            behind[ok] = more[ok]
            steps >>= 1
        return ahead, behind


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``w`` consecutive values, by doubling."""
    out, width = values, 1
    while width < w:
        step = min(width, w - width)
        out = pick(out[:-step], out[step:])
        width += step
    return out


def chosen(keys: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least key of one of the windows of ``w`` keys (ties: all of them)."""
    if len(keys) < w:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(keys, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, w, np.maximum) == keys)


def lag_runs(x: np.ndarray, lag: int) -> np.ndarray:
    """(begin, end, lag) of the stretches long enough for a run in which elements ``lag`` apart agree."""
    if len(x) <= lag:
        return np.zeros((0, 3), dtype=np.int64)
    equal = np.zeros(len(x) - lag + 2, dtype=np.int8)
    equal[1:-1] = x[:-lag] == x[lag:]
    edges = np.flatnonzero(np.diff(equal))
    begin, end = edges[::2], edges[1::2] + lag
    long = end - begin >= max(LEAST, TURNS * lag)
    return np.stack([begin[long], end[long], np.full(int(long.sum()), lag)], axis=1).astype(np.int64)


def scale_runs(x: np.ndarray, hashes: Hashes, shorter: int, k: int) -> np.ndarray:
    """(begin, end, period) of runs with a period in (shorter, k]."""
    w = 2 * (shorter + 1) - k + 1
    none = np.zeros((0, 3), dtype=np.int64)
    if len(x) < k + w:
        return none
    keys = hashes.grams(k)
    at = chosen(keys, w)
    at = at[np.argsort(keys[at], kind="stable")]
    gap = at[1:] - at[:-1]
    pair = np.flatnonzero((keys[at[1:]] == keys[at[:-1]]) & (gap > shorter) & (gap <= k))
    if not len(pair):
        return none
    a, d = at[pair], gap[pair]
    ahead, behind = hashes.extend(a, a + d)
    found = np.unique(np.stack([a - behind, a + d + ahead, d], axis=1), axis=0)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(LEAST, TURNS * found[:, 2])]
    right = [np.array_equal(x[b : e - q], x[b + q : e]) for b, e, q in found.tolist()]
    if not all(right):
        # Equal hashes of different ranges: these periods are compared directly.
        wrong = sorted(set(found[~np.array(right), 2].tolist()))
        found = np.concatenate([found[np.array(right)], *[lag_runs(x, q) for q in wrong]])
    return found


def find_runs(x: np.ndarray, document: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(document, begin, end, period) of all runs, in the order of these.

    ``x`` holds the documents' words with an element found nowhere else before, between and behind
    them; ``document`` is the number of the document at every place (of a separator, the one behind it),
    ``sizes`` the words of every document. Places count from the first element of ``x``.
    """
    place = np.arange(len(x))
    found = [lag_runs(x, lag) for lag in range(1, DIRECT + 1)]
    shorter, hashes = DIRECT, None
    longest = int(sizes.max(initial=0))
    while longest >= TURNS * (shorter + 1):
        enough = sizes >= TURNS * (shorter + 1)
        stays = enough[document]
        if hashes is None or 2 * stays.sum() < len(place):
            place, document = place[stays], document[stays]
            kept = x[place]
            hashes = Hashes(kept)
        k = shorter * 3 // 2
        runs = scale_runs(kept, hashes, shorter, k)
        # A run lies inside one document, so its places stay neighbours.
        runs[:, 1] += place[runs[:, 0]] - runs[:, 0]
        runs[:, 0] = place[runs[:, 0]]
        found.append(runs)
        shorter = k
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Of several periods of one stretch the smallest one counts.
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


Rewrite = Callable[[int | None, int], np.ndarray | None]


class Found(NamedTuple):
    """Runs (start, length, period) of one text of ``n`` words, and which original words remain of it."""

    n: int
    runs: list[tuple[int, int, int]]
    kept: np.ndarray


def block_runs(block: W.Words, ids: list, rewrite: Rewrite | None = None) -> list[Found]:
    """The runs of every document of a block of words."""
    sizes = W.counts(block)
    first = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(len(block.hash))
    if rewrite is not None:
        for i in np.flatnonzero(sizes).tolist():
            order = rewrite(ids[i], int(sizes[i]))
            if order is not None:
                source[first[i] : first[i + 1]] = first[i] + order
    document = np.repeat(np.arange(len(sizes)), sizes)
    # Document i begins after i + 1 separators.
    at = np.arange(len(source)) + document + 1
    whole = np.repeat(np.arange(len(sizes) + 1), np.append(sizes, 0) + 1)
    x = W.mix(np.arange(len(whole), dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    x[at] = block.hash[source]
    whole = np.minimum(whole, max(len(sizes) - 1, 0))
    runs = find_runs(x, whole, sizes) if len(sizes) else np.zeros((0, 3), np.int64)
    owner = whole[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    drop = np.zeros(len(x) + 1, dtype=np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    stays = (np.cumsum(drop)[:-1] == 0)[at]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out = []
    for i, n in enumerate(sizes.tolist()):
        mine = runs[bounds[i] : bounds[i + 1]]
        begin = int(first[i]) + i + 1
        listed = [(b - begin, e - b, q) for b, e, q in mine.tolist()]
        inside = slice(int(first[i]), int(first[i + 1]))
        out.append(Found(n, listed, source[inside][stays[inside]]))
    return out


def _joined(data: np.ndarray, block: W.Words, kept: np.ndarray) -> bytes:
    """The words ``kept`` of the block, joined by one space."""
    parts = []
    for low in range(0, len(kept), JOINED):
        some = kept[low : low + JOINED]
        begin, end = block.start[some], block.end[some]
        base = int(begin.min())
        text = data[base : int(end.max())].tobytes()
        parts.append(b" ".join([text[b:e] for b, e in zip((begin - base).tolist(), (end - base).tolist(), strict=True)]))
    return b" ".join(parts)


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of every document.

    ``collapsed`` keeps of every run its first period: a word that lies in any run behind that run's
    first period goes, the others are joined by one space. ``rewrite(doc_id, n)`` may give the
    numbers of the original words that stand for a text of n > 0 words instead. ``docs`` has doc_id
    and text; other columns are ignored. Null, empty and blank texts have no words, no runs and an
    empty collapsed text; repeated rows get equal results; an empty table gives an empty table. A
    task's memory grows with its longest text (some 150 bytes a word), not with its number of runs.
    """
    prepare_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = W.texts(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for block in W.blocks(t):
                found = block_runs(block, ids[block.first : block.last], rewrite)
                # Blocks of one long text are handed on one by one.
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.last - block.first),
                        pa.array([f.n for f in found], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f.runs] for f in found], pa.list_(_RUN)),
                        pa.array([_joined(t.data, block, f.kept) for f in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """One document in ten, by the checksum of its id, repeats some of its words to the end."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def strongest(runs: Column) -> Column:
    """The run with the most periods; of equal ones the first by start, then by period."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def runs_digest(runs: Column) -> Column:
    """SHA-256 of the runs, one line each."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("").cast("binary"), 256)
