"""Quality scores by a Bradley-Terry model on text features.

Each labelled good document is preferred to each labelled bad one: ``P(a over b) =
sigmoid(w.(f(a) - f(b)))``. The weights minimise the logistic loss over all such pairs of all labelled
documents. The threshold is the quantile of their scores at the share of bad documents; a score is
reported as ``sigmoid((w.f - threshold) / scale)``, so one half lies on the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .sampling import labelled_documents
from .storage import prepare_workers, stored

#: Partners that ``fit_pairs`` gives each document of the rarer class.
PARTNERS = 16
#: Scores from -REACH to REACH fall into BINS bins, COARSE of which share the products of features.
REACH, BINS, COARSE = 40.0, 1024, 32
#: Standardised features are whole numbers of this part, so that sums are exact.
STEPS = 1024
#: Words of the segments whose worst one enters the features: bad passages stand out in long good texts.
SEGMENT = 32
RIDGE = 1e-3
SPREAD = 6.0
#: Passages outside these are ordinary: symbols of markup and noise.
SYMBOLS = b"#*$%&|<>"

FEATURES = (
    "log_words", "word_length", "lines", "upper", "digit", "symbol", "sentence", "exclaim", "beyond_ascii",
    "upper_words", "symbol_ends", "exclaim_ends", "bare_words", "repeats", "distinct", "numbers",
    "worst_upper", "worst_symbol", "worst_exclaim", "worst_bare", "worst_repeats", "worst_distinct", "worst_numbers",
)


def _member(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER = _member(bytes(range(ord("A"), ord("Z") + 1)))
_LETTER = _UPPER | _member(bytes(range(ord("a"), ord("z") + 1))) | _member(bytes(range(128, 256)))
_DIGIT = _member(b"0123456789")
_SYMBOL, _SENTENCE, _EXCLAIM = _member(SYMBOLS), _member(b".,;:?'\"()-"), _member(b"!")


def features(t: W.Texts, block: W.Words) -> np.ndarray:
    """(rows, FEATURES) of the documents of a block; a text without a word has zeros."""
    low, high = int(t.start[block.first]), int(t.end[block.last - 1])
    data = t.data[low:high]
    start, end = t.start[block.first : block.last] - low, t.end[block.first : block.last] - low
    row, n = block.row - block.first, W.counts(block)
    begin, stop = block.start - low, block.end - low
    words = np.maximum(n, 1)
    size = (stop - begin).astype(float)
    chars = np.maximum(np.bincount(row, weights=size, minlength=len(n)), 1)

    def inside(mask: np.ndarray) -> np.ndarray:
        return W.range_sums(mask, begin, stop)

    letters, uppers, digits = inside(_LETTER[data]), inside(_UPPER[data]), inside(_DIGIT[data])
    last = data[stop - 1] if len(stop) else np.zeros(0, np.uint8)
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (block.hash[1:] == block.hash[:-1]) & (row[1:] == row[:-1])
    marks = {
        "upper": (uppers == letters) & (letters > 1),
        "symbol": _SYMBOL[last],
        "exclaim": _EXCLAIM[last],
        "bare": letters + digits == 0,
        "repeats": again,
        "numbers": (digits > 0) & (letters == 0),
    }
    # Segments of SEGMENT words; the last one of a text also covers what is left.
    first_word = np.concatenate([[0], np.cumsum(n)])[:-1]
    segments = np.maximum(n // SEGMENT, (n > 0).astype(np.int64))
    first_segment = np.concatenate([[0], np.cumsum(segments)])
    place = np.arange(len(row)) - first_word[row]
    segment = first_segment[row] + np.minimum(place // SEGMENT, segments[row] - 1)
    in_segment = np.maximum(np.bincount(segment, minlength=int(first_segment[-1])), 1)
    packed = np.unique((segment.astype(np.uint64) << np.uint64(40)) | (block.hash >> np.uint64(24)))
    distinct = np.bincount((packed >> np.uint64(40)).astype(np.int64), minlength=int(first_segment[-1])) / in_segment
    full = np.flatnonzero(segments)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=len(n)) / words

    def worst(shares: np.ndarray, pick=np.maximum) -> np.ndarray:
        out = np.zeros(len(n))
        if len(full):
            out[full] = pick.reduceat(shares, first_segment[:-1][full])
        return out

    def share(mark: str) -> np.ndarray:
        return np.bincount(segment, weights=marks[mark], minlength=int(first_segment[-1])) / in_segment

    mean_distinct = np.zeros(len(n))
    if len(full):
        mean_distinct[full] = np.add.reduceat(distinct, first_segment[:-1][full]) / segments[full]
    columns = [
        np.log1p(n) / 10, chars / words / 10 * (n > 0), np.minimum(W.range_sums(data == 10, start, end) / words, 1),
        np.bincount(row, weights=uppers, minlength=len(n)) / chars, np.bincount(row, weights=digits, minlength=len(n)) / chars,
        *[W.range_sums(table[data], start, end) / chars for table in (_SYMBOL, _SENTENCE, _EXCLAIM)],
        W.range_sums(data >= 128, start, end) / chars,
        *[per_row(marks[m]) for m in ("upper", "symbol", "exclaim", "bare", "repeats")], mean_distinct, per_row(marks["numbers"]),
        *[worst(share(m)) for m in ("upper", "symbol", "exclaim", "bare", "repeats")], worst(distinct, np.minimum), worst(share("numbers")),
    ]
    return np.stack(columns, axis=1)


class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -SPREAD, SPREAD) @ self.weights


def fit_pairs(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS, seed: int = 7) -> np.ndarray:
    """Weights of the Bradley-Terry model over pairs (good, bad): Newton steps on the ridged logistic loss.

    Every document of the rarer class meets ``partners`` of the other, drawn with a fixed seed.
    """
    rng = np.random.default_rng(seed)
    n = partners * min(len(good), len(bad))
    if len(good) <= len(bad):
        a, b = np.repeat(np.arange(len(good)), partners), rng.integers(len(bad), size=n)
    else:
        a, b = rng.integers(len(good), size=n), np.repeat(np.arange(len(bad)), partners)
    d = good[a] - bad[b]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # probability of the wrong order
        step = np.linalg.solve((d.T * (p * (1 - p))) @ d / n + RIDGE * np.eye(len(w)), RIDGE * w - d.T @ p / n)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = W.texts(batch.column("text"))
        for block in W.blocks(t):
            x = features(t, block)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(block.first, len(x)), batch.column("label").slice(block.first, len(x)),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel())),
                ],
                names=["doc_id", "label", "x"],
            )


def _totals(rows: DataFrame, sums) -> dict[int, int]:
    """Place -> total of the whole numbers that ``sums`` (label, x) gives by place, added up in Spark.

    Whole numbers, so the totals do not depend on the order of the rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                found = sums(batch.column("label").to_numpy() > 0, x)
                total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "total"])

    found = rows.select("label", "x").mapInArrow(part, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    return dict(zip(found["place"].to_pylist(), found["total"].to_pylist(), strict=True))


def _dense(totals: dict[int, int], shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    out[list(totals)] = list(totals.values())
    return out.reshape(shape)


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((scores + REACH) * (BINS / (2 * REACH))), 0, BINS - 1).astype(np.int64)


def _standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features in whole steps of 1 / ``STEPS``."""
    return np.rint(np.clip((x - mean) / spread, -SPREAD, SPREAD) * STEPS)


def _histograms(mean: np.ndarray, spread: np.ndarray, weights: np.ndarray):
    """Per class and bin of scores the number of rows and the sums of their features; per class and coarse bin those of the products."""

    def sums(good: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = _standard(x, mean, spread)
        d = z.shape[1]
        at = _bins(z @ weights / STEPS) + BINS * good
        first = np.stack([np.bincount(at, weights=c, minlength=2 * BINS) for c in (np.ones(len(z)), *z.T)], axis=1)
        second = np.zeros((2 * BINS // COARSE, d, d))
        for group in np.unique(at // COARSE):
            some = z[at // COARSE == group]
            second[group] = some.T @ some
        return np.concatenate([first.ravel(), second.ravel()]).astype(np.int64)

    return sums


def _moments(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(2, BINS) counts, (2, BINS, d) sums of features, (2, BINS / COARSE, d, d) sums of their products."""
    d = len(mean)
    totals = _totals(rows, _histograms(mean, spread, weights))
    split = 2 * BINS * (d + 1)
    first = _dense({k: v for k, v in totals.items() if k < split}, (2, BINS, d + 1))
    second = _dense({k - split: v for k, v in totals.items() if k >= split}, (2, BINS // COARSE, d, d))
    return first[:, :, 0], first[:, :, 1:] / STEPS, second / STEPS**2


def fit_all_pairs(rows: DataFrame, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Weights of the Bradley-Terry model over all pairs (good, bad) of the rows (label, x): damped Newton steps.

    A pair's loss depends on the difference of two scores alone. Scores are binned, so that all pairs
    of two bins are taken at once: a step is one aggregate over the rows, and its cost is that of the
    rows, not of the pairs.
    """
    w = np.zeros(len(mean))
    centre = (np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH
    wrong = 1 / (1 + np.exp(np.clip(centre[:, None] - centre[None, :], -35, 35)))  # good bin, bad bin
    curved = wrong * (1 - wrong)

    def state(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        (bad_n, good_n), (bad_x, good_x), (bad_xx, good_xx) = _moments(rows, mean, spread, w)
        pairs = good_n.sum() * bad_n.sum()
        value = good_n @ -np.log1p(-np.minimum(wrong, 1 - 1e-16)) @ bad_n / pairs + RIDGE / 2 * w @ w
        slope = RIDGE * w - ((wrong @ bad_n) @ good_x - (good_n @ wrong) @ bad_x) / pairs
        # Products are kept by coarse bins, with the mean curvature of their rows.
        hessian = -(good_x.T @ curved @ bad_x)
        hessian = hessian + hessian.T
        for n, xx, weight in ((good_n, good_xx, curved @ bad_n), (bad_n, bad_xx, good_n @ curved)):
            by = (n * weight).reshape(-1, COARSE).sum(axis=1) / np.maximum(n.reshape(-1, COARSE).sum(axis=1), 1)
            hessian = hessian + np.tensordot(by, xx, 1)
        return value, slope, hessian / pairs + RIDGE * np.eye(len(w))

    value, slope, hessian = state(w)
    for _ in range(30):
        step, size = np.linalg.solve(hessian, slope), 1.0
        while True:
            after = state(w - size * step)
            if after[0] <= value or size < 1 / 64:
                break
            size /= 2
        if after[0] > value:
            break
        gained, w = value - after[0], w - size * step
        value, slope, hessian = after
        if np.abs(size * step).max() < 1e-4 or gained < 1e-9:
            break
    return w


def _order_statistics(rows: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], counts: np.ndarray, ranks: list[int]) -> list[float]:
    """Scores at the 0-based ``ranks`` of all rows, to ``1 / BINS`` of a bin: the bins that hold them are counted again, finer."""
    mean, spread, weights = model
    before = np.concatenate([[0], np.cumsum(counts)])
    bins = [int(np.searchsorted(before, rank, side="right")) - 1 for rank in ranks]
    width = 2 * REACH / BINS
    low = np.array([b * width - REACH for b in bins])

    def finer(_: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = _standard(x, mean, spread) @ weights / STEPS
        at = _bins(s)
        inside = [np.clip(np.floor((s[at == b] - l) / width * BINS), 0, BINS - 1).astype(np.int64) for b, l in zip(bins, low, strict=True)]
        return np.concatenate([np.bincount(i, minlength=BINS) for i in inside])

    fine = _dense(_totals(rows, finer), (len(ranks), BINS))
    places = [int(np.searchsorted(np.cumsum(f), rank - before[b], side="right")) for f, rank, b in zip(fine, ranks, bins, strict=True)]
    return [float(l + (p + 0.5) * width / BINS) for l, p in zip(low, places, strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", eligible: Column | None = None) -> Model:
    """Fit on every labelled document; only sums per bin of scores reach the driver.

    The ``FEATURES`` of the labelled documents are stored and read once per step. Without a good or
    without a bad document all scores are one half or more.
    """
    prepare_workers(docs.sparkSession)
    chosen = labelled_documents(docs, labels, label, eligible)
    rows = stored(chosen.select("doc_id", "text", "label").mapInArrow(_sampled, "doc_id long, label int, x array<double>"), "quality-features")
    d = len(FEATURES)
    # Decimals, so that the sums do not depend on the order of the rows.
    exact = lambda value: F.sum(value.cast("decimal(30,14)")).cast("double")
    value = [F.get("x", F.lit(i)) for i in range(d)]
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("good"),
        F.array(*[exact(v) for v in value]).alias("x"), F.array(*[exact(v * v) for v in value]).alias("xx"),
    ).first()
    if not sums.good or sums.good == sums.n:
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    mean = np.array(sums.x) / sums.n
    spread = np.maximum(np.sqrt(np.maximum(np.array(sums.xx) / sums.n - mean**2, 0)), 1e-6)
    weights = fit_all_pairs(rows, mean, spread)
    n, x, xx = _moments(rows, mean, spread, weights)
    at = (sums.n - sums.good) / sums.n * (sums.n - 1)
    below, above = _order_statistics(rows, (mean, spread, weights), n.sum(axis=0), [int(at), min(int(at) + 1, sums.n - 1)])
    average = x.sum(axis=(0, 1)) @ weights / sums.n
    variance = weights @ xx.sum(axis=(0, 1)) @ weights / sums.n - average**2
    return Model(mean, spread, weights, below + (at - int(at)) * (above - below), float(max(np.sqrt(max(variance, 0)), 1e-6) / 2))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every whole text of ``docs`` (doc_id, text, others ignored).

    Null and empty texts are scored like any text, by features of zero. Repeated rows get equal
    scores; an empty table gives an empty table.
    """
    prepare_workers(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = W.texts(batch.column("text"))
            for block in W.blocks(t):
                raw = model.raw(features(t, block))
                p = 1 / (1 + np.exp(-np.clip((raw - model.threshold) / model.scale, -35, 35)))
                ids = batch.column("doc_id").slice(block.first, len(p))
                yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, score double, predicted int")
