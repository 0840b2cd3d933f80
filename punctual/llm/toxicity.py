"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the terms of a text (lower-case runs of letters and digits) and their heads of three
to seven characters, each present or not. The model is ``P(grade > j) = sigmoid(w.x - cut_j)`` with
one weight vector for all ordered cuts; a document's severity is its expected grade.

Labels say toxic or not; grades are drawn from them: 0 for clean documents, and for toxic ones 1 or
2 by whether they hold more different features that mark toxic documents than the median does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .sampling import labelled_sample
from .storage import prepare_workers, stored

#: Labelled documents that the model is fitted on.
SAMPLE = 20_000
HEADS = (3, 4, 5, 6, 7)
#: A feature enters the model when it is in this many documents, and its log-likelihood ratio and
#: log odds against clean documents are at least these; of those the ``FEATURES`` strongest.
MIN_DOCUMENTS, MIN_RATIO, MIN_ODDS, FEATURES = 4, 14.0, 2.0, 4_096
GRADES = 3
RIDGE, STEPS = 1e-3, 400
_LOW16 = np.uint64(0xFFFF)


class Model(NamedTuple):
    """Sorted feature hashes with their shared weights, and one cut between each two grades."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray


def document_features(block: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature occurrence of the block."""
    rows, codes = [block.row], [block.hash]
    for i, head in enumerate(block.heads):
        longer = head != block.hash
        rows.append(block.row[longer])
        codes.append(W.mix(head[longer] + np.uint64(i + 1)))
    return np.concatenate(rows), np.concatenate(codes)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = W.texts(batch.column("text"))
        for block in W.blocks(t, W.TERMS, HEADS):
            row, code = document_features(block)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
            n = np.bincount(row[new] - block.first, minlength=block.last - block.first)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(code[new].astype(np.int64)))
            size = block.last - block.first
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(block.first, size), batch.column("label").slice(block.first, size), lists],
                names=["doc_id", "label", "features"],
            )


def _only(features: np.ndarray):
    """Keeps of each row's features the numbers of those in the sorted ``features``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            sizes = np.diff(lists.offsets.to_numpy())
            code = lists.flatten().to_numpy().astype(np.uint64)
            place = np.minimum(np.searchsorted(features, code), len(features) - 1)
            hit = features[place] == code
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(place[hit]))], names=["label", "hits"])

    return keep


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_cumulative(rows: np.ndarray, columns: np.ndarray, n_columns: int, grade: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts that minimise the mean negative log likelihood plus a ridge on the weights.

    ``rows`` and ``columns`` are the places of ones. Adam steps; the cuts are a first one and
    logarithms of the gaps, so they stay ordered.
    """
    n = len(grade)
    weights = np.zeros(n_columns)
    above = [np.clip((grade > j).mean(), 1e-4, 1 - 1e-4) for j in range(grades - 1)]
    start = -np.log(np.array(above) / (1 - np.array(above)))
    gaps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    state = np.concatenate([weights, gaps])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        weights, gaps = state[:n_columns], state[n_columns:]
        cuts = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        z = np.bincount(rows, weights=weights[columns], minlength=n)
        upper = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - cuts), np.zeros((n, 1))], axis=1)  # P(grade >= j)
        i = np.arange(n)
        p = np.maximum(upper[i, grade] - upper[i, grade + 1], 1e-12)
        slope = upper * (1 - upper)
        d_low, d_high = slope[i, grade] / p, slope[i, grade + 1] / p
        d_z = -(d_low - d_high) / n
        d_cut = np.zeros(grades - 1)
        for j in range(grades - 1):
            d_cut[j] = (d_low[grade == j + 1].sum() - d_high[grade == j].sum()) / n
        d_gaps = np.concatenate([[d_cut.sum()], [d_cut[j:].sum() * np.exp(gaps[j]) for j in range(1, grades - 1)]])
        gradient = np.concatenate([np.bincount(columns, weights=d_z[rows], minlength=n_columns) + RIDGE * weights / 10, d_gaps])
        mean += 0.1 * (gradient - mean)
        square += 0.001 * (gradient**2 - square)
        state = state - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-10)
    weights, gaps = state[:n_columns], state[n_columns:]
    return weights, gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents; feature counts are taken in Spark, the chosen rows' few features fitted here.

    Without a toxic or without a clean document in the sample the model has no feature and finds nothing toxic.
    """
    prepare_workers(docs.sparkSession)
    chosen = labelled_sample(docs, labels, label, sample)
    rows = stored(chosen.select("doc_id", "text", "label").mapInArrow(_distinct, "doc_id long, label int, features array<long>"), "toxic-sample")
    size = {r["label"] > 0: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 35.0))
    counts = (
        rows.select(F.explode("features").alias("feature"), (F.col("label") > 0).cast("long").alias("t"))
        .groupBy("feature").agg(F.sum("t").alias("a"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
        .withColumn("b", F.col("n") - F.col("a"))
    )
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    expected = F.col("n") * F.lit(toxic / (toxic + clean))
    ratio = 2 * (F.col("a") * F.log(F.greatest(F.col("a"), F.lit(0.5)) / expected) + F.col("b") * F.log(F.greatest(F.col("b"), F.lit(0.5)) / (F.col("n") - expected)))
    strongest = (
        counts.select("feature", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= MIN_RATIO) & (F.col("odds") >= MIN_ODDS))
        .orderBy(F.col("ratio").desc(), "feature").limit(FEATURES).select("feature")
    )
    features = np.sort(strongest.toArrow()["feature"].to_numpy().astype(np.int64).astype(np.uint64))
    if not len(features):
        return Model(features, np.zeros(0), np.full(GRADES - 1, 35.0))
    hits = rows.select("label", "features").mapInArrow(_only(features), "label int, hits array<long>").toArrow()
    n_hits = np.array([len(h) for h in hits["hits"]], dtype=np.int64)
    is_toxic = hits["label"].to_numpy() > 0
    grade = np.where(is_toxic, 1 + (n_hits > np.median(n_hits[is_toxic])), 0)
    columns = hits["hits"].combine_chunks().flatten().to_numpy()
    weights, cuts = fit_cumulative(np.repeat(np.arange(len(grade)), n_hits), columns, len(features), grade)
    return Model(features, weights, cuts)


SCHEMA = "doc_id long, severity double, grade int, score double, toxic int"


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, score, toxic) of every whole text of ``docs`` (doc_id, text, others ignored).

    ``severity`` is the expected grade (0 to 2), ``score`` the probability of grade 1 or more,
    ``grade`` the likeliest grade and ``toxic`` 1 where ``score`` is at least one half. Null and
    empty texts have no feature. Repeated rows get equal results; an empty table gives an empty table.
    """
    prepare_workers(docs.sparkSession)
    low = np.zeros(1 << 16, dtype=bool)
    low[(model.features & _LOW16).astype(np.int64)] = True

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = W.texts(batch.column("text"))
            total = np.zeros(len(t.start))
            for block in W.blocks(t, W.TERMS, HEADS):
                row, code = document_features(block)
                at = np.flatnonzero(low[(code & _LOW16).astype(np.int64)])
                place = np.searchsorted(model.features, code[at])
                hit = place < len(model.features)
                hit[hit] = model.features[place[hit]] == code[at][hit]
                pair = np.unique(row[at[hit]] * max(len(model.features), 1) + place[hit])
                if len(pair):
                    total += np.bincount(pair // len(model.features), weights=model.weights[pair % len(model.features)], minlength=len(total))
            above = _sigmoid(total[:, None] - model.cuts)
            each = -np.diff(np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)),
                    pa.array(above[:, 0]), pa.array((above[:, 0] >= 0.5).astype(np.int32)),
                ],
                names=["doc_id", "severity", "grade", "score", "toxic"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(grade, SCHEMA)
