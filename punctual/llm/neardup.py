"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its runs of five words. The weight of a run is its count in the
document times ``1 + ln(1/max(s, floor)) / ln(1/floor)``, where ``s`` is the share of all documents
that hold it: 2 for a rare run, towards 1 for one that everybody has. Improved consistent weighted
sampling (Ioffe 2010) draws ``SAMPLES`` (run, level) pairs per document; two documents draw the same
pair with a probability equal to their weighted Jaccard similarity. Pairs of samples form ``BANDS``
band keys, documents that share a band key are candidates, and a candidate link counts when the
exact weighted Jaccard similarity of the whole texts is at least ``SIMILARITY``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .components import components
from .sampling import row_mark
from .storage import prepare_workers, stored

SHINGLE = 5
SIMILARITY = 0.8
#: 1 - (1 - 0.8^2)^9: a pair at the threshold shares a band with probability 0.9999.
ROWS_PER_BAND, BANDS = 2, 9
SAMPLES = ROWS_PER_BAND * BANDS
#: Members of a bucket that all others are compared with.
LEADERS = 3
#: Runs in fewer than this share of documents all count as equally rare. At most
#: 2 * (mean runs of a document) / floor runs are ever held as "common" (see ``common_runs``).
FLOOR = 0.01
#: Documents of one block of the first counting pass.
BLOCK_DOCUMENTS = 2_000
BLOCK_RUNS = 2_000_000

_LOW16 = np.uint64(0xFFFF)
_BITS = 1 << 16


def _gamma2() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 and scale 1 at the middles of 2^16 steps."""
    p = (np.arange(_BITS) + 0.5) / _BITS
    low, high = np.zeros(_BITS), np.full(_BITS, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


_R = _gamma2().astype(np.float32)
_R_INVERSE = (1 / _R).astype(np.float32)
_LN_C = np.log(_R)
_BETA = ((np.arange(_BITS) + 0.5) / _BITS).astype(np.float32)
_SEEDS = np.random.default_rng(41).integers(1, 2**63, SAMPLES, dtype=np.uint64)


class Common:
    """Runs that at least ``FLOOR`` of all documents hold, with their shares."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.share = ids[order].astype(np.uint64), share[order]
        self.low = np.zeros(_BITS, dtype=bool)
        self.low[(self.ids & _LOW16).astype(np.int64)] = True

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` that are common, and where they stand in ``self.ids``."""
        at = np.flatnonzero(self.low[(ids & _LOW16).astype(np.int64)])
        place = np.searchsorted(self.ids, ids[at])
        hit = place < len(self.ids)
        hit[hit] = self.ids[place[hit]] == ids[at][hit]
        return at[hit], place[hit]

    def weights(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        factor = np.full(len(ids), 2.0)
        if len(self.ids):
            at, place = self.find(ids)
            factor[at] = 1 + np.log(1 / np.maximum(self.share[place], FLOOR)) / np.log(1 / FLOOR)
        return tf * factor


def document_runs(block: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row within the block, 48-bit run id and count, sorted by row and id."""
    row, code = W.shingles(block, SHINGLE)
    packed = ((row - block.first).astype(np.uint64) << np.uint64(48)) | (code >> np.uint64(16))
    packed.sort()
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), tf


def _text_blocks(batch: pa.RecordBatch) -> Iterator[W.Words]:
    return W.blocks(W.texts(batch.column("text")))


def _count_sorted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


def _locally_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in at least half the floor share of a block of documents: (id, documents, block size)."""
    parts: list[np.ndarray] = []
    held = documents = 0

    def flush() -> pa.RecordBatch:
        ids, n = _count_sorted(np.concatenate(parts))
        keep = n >= FLOOR / 2 * documents
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64)), pa.array(np.full(int(keep.sum()), documents, np.int64))],
            names=["id", "n", "block"],
        )

    for batch in batches:
        for block in _text_blocks(batch):
            _, ids, _ = document_runs(block)
            parts.append(ids)
            held += len(ids)
            documents += block.last - block.first
            if documents >= BLOCK_DOCUMENTS or held >= BLOCK_RUNS:
                yield flush()
                parts, held, documents = [], 0, 0
    if parts:
        yield flush()


def common_runs(texts: DataFrame) -> Common:
    """Runs that at least ``FLOOR`` of the documents hold, counted over all documents, exactly.

    A run of that share has it in at least one block of documents. First every block names the runs
    that reach half the floor in it. A run survives when its named counts plus half the floor of the
    blocks that did not name it can still reach the floor, which needs named counts of half the
    floor of all documents: at most ``2 * (mean runs of a document) / FLOOR`` runs survive,
    whatever the number of documents. Those are counted in a second pass; only they reach the driver.
    """
    total = texts.count()
    if not total:
        return Common(np.zeros(0, np.uint64), np.zeros(0))
    named = texts.select("text").mapInArrow(_locally_common, "id long, n long, block long")
    survivors = (
        named.groupBy("id")
        .agg(F.sum("n").alias("n"), F.sum("block").alias("block"))
        .where(F.col("n") + FLOOR / 2 * (total - F.col("block")) >= FLOOR * total)
        .select("id")
        .toArrow()
    )
    wanted = Common(survivors["id"].to_numpy().astype(np.uint64), np.zeros(len(survivors)))
    if not len(wanted.ids):
        return wanted

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted.ids), dtype=np.int64)
        for batch in batches:
            for block in _text_blocks(batch):
                _, place = wanted.find(document_runs(block)[1])
                n += np.bincount(place, minlength=len(n))
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted.ids[some].astype(np.int64)), pa.array(n[some])], names=["id", "n"])

    exact = (
        texts.select("text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FLOOR * total).toArrow()
    )
    return Common(exact["id"].to_numpy().astype(np.uint64), exact["n"].to_numpy() / total)


def weighted_samples(ids: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Improved consistent weighted samples of sets given one after the other: (sets, SAMPLES) hashes.

    The random variables of a run and sample come from tables of quantiles, addressed by bits of a
    hash of both, so equal runs see equal variables everywhere.
    """
    out = np.empty((len(starts), SAMPLES), dtype=np.uint64)
    sizes = np.diff(np.append(starts, len(ids)))
    ln_w = np.log(weights).astype(np.float32)
    for k in range(SAMPLES):
        z = (ids ^ _SEEDS[k]) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(29)
        at = (z & _LOW16).astype(np.int32)
        beta = _BETA[((z >> np.uint64(16)) & _LOW16).astype(np.int32)]
        t = np.floor(ln_w * _R_INVERSE[at] + beta)
        ln_a = _LN_C[((z >> np.uint64(32)) & _LOW16).astype(np.int32)] - _R[at] * (t - beta + 1)
        least = np.minimum.reduceat(ln_a, starts)
        hits = np.flatnonzero(ln_a == np.repeat(least, sizes))
        won = hits[np.searchsorted(hits, starts)]
        out[:, k] = W.mix(ids[won] + t[won].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _SEEDS[k])
    return out


def sequence_keys(block: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and a 64-bit hash of the word sequence of every row of the block."""
    n = W.counts(block)
    ends = np.cumsum(n)
    place = np.arange(len(block.hash)) - np.repeat(ends - n, n)
    total = np.zeros(len(block.hash) + 1, dtype=np.uint64)
    np.cumsum(W.mix(block.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    return n, W.mix(total[ends] - total[ends - n] + n.astype(np.uint64))


def signatures(texts: DataFrame, common: Common) -> DataFrame:
    """(doc_id, mark, key, weight, bands) per row of (doc_id, mark, text); a text without a word has no key, weight 0 and no band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for batch in batches:
            keys, weights, bands, sizes = [], [], [], []
            for block in _text_blocks(batch):
                n, key = sequence_keys(block)
                row, ids, tf = document_runs(block)
                weight = common.weights(ids, tf)
                full = n > 0
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                total = np.zeros(len(n))
                if len(starts):
                    total[full] = np.add.reduceat(weight, starts)
                    drawn = weighted_samples(ids, weight, starts)
                    joined = seeds[None, :] + np.zeros((len(starts), 1), np.uint64)
                    for i in range(ROWS_PER_BAND):
                        joined = W.mix(joined ^ drawn[:, i::ROWS_PER_BAND])
                    bands.append(joined.ravel())
                keys.append(np.where(full, key, 0))
                weights.append(total)
                sizes.append(np.where(full, BANDS, 0))
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            key = np.concatenate(keys).astype(np.uint64).astype(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(key, mask=size == 0),
                    pa.array(np.concatenate(weights) if weights else np.zeros(0)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.astype(np.int64))),
                ],
                names=["doc_id", "mark", "key", "weight", "bands"],
            )

    return texts.select("doc_id", "mark", "text").mapInArrow(sign, "doc_id long, mark long, key long, weight double, bands array<long>")


def _packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, runs, counts): the sorted 64-bit ids of a text's runs and their 32-bit counts, in the same order."""
    for batch in batches:
        keys, runs, counts = [], [], []
        for block in _text_blocks(batch):
            n, key = sequence_keys(block)
            row, ids, tf = document_runs(block)
            tf = tf.astype(np.uint32)
            bounds = np.searchsorted(row, np.arange(len(n) + 1))
            for i in np.flatnonzero(n):
                keys.append(key[i])
                runs.append(ids[bounds[i] : bounds[i + 1]].tobytes())
                counts.append(tf[bounds[i] : bounds[i + 1]].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(keys, dtype=np.uint64).astype(np.int64)), pa.array(runs, pa.binary()), pa.array(counts, pa.binary())],
            names=["key", "runs", "counts"],
        )


def _ids_and_weights(common: Common, runs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(runs, dtype=np.uint64)
    return ids, common.weights(ids, np.frombuffer(counts, dtype=np.uint32))


def _weighted_jaccard(common: Common, a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    (x_id, x_w), (y_id, y_w) = _ids_and_weights(common, *a), _ids_and_weights(common, *b)
    place = np.minimum(np.searchsorted(y_id, x_id), len(y_id) - 1)
    same = y_id[place] == x_id
    shared = np.minimum(x_w[same], y_w[place[same]]).sum()
    return float(shared / (x_w.sum() + y_w.sum() - shared))


def text_runs(texts: DataFrame, representatives: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, runs, counts) of the texts of the ``needed`` keys, each once."""
    wanted = representatives.join(needed, "key").select("rep").distinct()
    return stored(
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        .select("text")
        .mapInArrow(_packed_runs, "key long, runs binary, counts binary")
        .join(needed, "key", "left_semi")
        .dropDuplicates(["key"]),
        "runs",
    )


def verified(pairs: DataFrame, texts: DataFrame, representatives: DataFrame, common: Common) -> DataFrame:
    """Of the (a, b) key pairs, those whose texts' weighted Jaccard similarity reaches the threshold."""
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    runs = text_runs(texts, representatives, needed)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of = [zip(batch.column(f"runs_{c}"), batch.column(f"counts_{c}"), strict=True) for c in "ab"]
            like = np.array(
                [_weighted_jaccard(common, *((r.as_py(), n.as_py()) for r, n in pair)) for pair in zip(*texts_of, strict=True)],
                dtype=np.float64,
            )
            keep = pa.array(like >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return (
        pairs.join(runs.toDF("a", "runs_a", "counts_a"), "a")
        .join(runs.toDF("b", "runs_b", "counts_b"), "b")
        .mapInArrow(compare, "a long, b long")
    )


def _led(members: DataFrame, order: list) -> DataFrame:
    """(bucket, leader, leader_weight, place): the first ``LEADERS`` members of each bucket by ``order``."""
    ranked = members.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    return ranked.where(F.col("place") <= LEADERS).select(
        "bucket", F.col("key").alias("leader"), F.col("weight").alias("leader_weight"), "place"
    )


def _candidates(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct (a, b), a below b, of a member and a leader of its bucket whose weights allow the threshold."""
    met = members.join(leaders, "bucket").where("key != leader")
    return (
        met.where(F.least("weight", "leader_weight") >= F.lit(SIMILARITY - 1e-9) * F.greatest("weight", "leader_weight"))
        .select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
        .distinct()
    )


def _run_weights(common: Common):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, run, w) of every run of the texts."""
        for batch in batches:
            for key, runs, counts in zip(batch.column("key").to_pylist(), batch.column("runs"), batch.column("counts"), strict=True):
                ids, weights = _ids_and_weights(common, runs.as_py(), counts.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), key)), pa.array(ids.astype(np.int64)), pa.array(weights)],
                    names=["key", "run", "w"],
                )

    return each


def rare_buckets(runs: DataFrame, common: Common) -> DataFrame:
    """(bucket, key, weight, rest): every text under its rarest runs, for an exact search among the texts of ``runs``.

    With runs in order of the number of texts that hold them, two texts of similarity ``SIMILARITY``
    share one of the rarest runs that make up ``1 - SIMILARITY`` of each one's weight (prefix
    filtering). A text with more than that in runs of its own has no partner and drops out.
    ``rest`` is the weight of the bucket's run and all that are more common: what a text can share
    with one whose rarest shared run this is.
    """
    each = stored(runs.mapInArrow(_run_weights(common), "key long, run long, w double"), "run-weights")
    shared = each.groupBy("run").agg(F.count("*").alias("texts")).where("texts > 1")
    total = each.groupBy("key").agg(F.sum("w").alias("weight"))
    met = each.join(shared, "run").join(total, "key")
    rarest_last = Window.partitionBy("key").orderBy(F.col("texts").desc(), F.col("run").desc())
    # Weight of this run and all that are more common: what is left above it must reach the threshold.
    rest = F.sum("w").over(rarest_last.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("rest", rest).where(F.col("rest") >= F.lit(SIMILARITY - 1e-9) * F.col("weight")).select(
        F.col("run").alias("bucket"), "key", "weight", "rest"
    )


def _between_classes(rare: DataFrame, asking: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct (a, b), a below b, of all texts of a bucket that the links do not connect yet, one of them of the ``asking`` keys.

    A pair at the threshold shares ``SIMILARITY / (1 + SIMILARITY)`` of both weights, all of it in the
    rest of both texts at their rarest shared run; pairs whose rests are too small there are left out.
    """
    roots = components(linked).withColumnRenamed("node", "key")
    placed = rare.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = placed.join(asking.withColumn("asks", F.lit(True)), "key", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    placed = stored(placed.join(mixed, "bucket", "left_semi"), "mixed")
    x, y = placed.where("asks").alias("x"), placed.alias("y")
    least = F.lit(SIMILARITY / (1 + SIMILARITY) - 1e-9) * (F.col("x.weight") + F.col("y.weight"))
    allowed = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.root") != F.col("y.root"))
        & (~F.col("y.asks") | (F.col("x.key") < F.col("y.key")))
        & (F.least("x.weight", "y.weight") >= F.lit(SIMILARITY - 1e-9) * F.greatest("x.weight", "y.weight"))
        & (F.least("x.rest", "y.rest") >= least)
    )
    return x.join(y, allowed).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def links(texts: DataFrame, signed: DataFrame, common: Common) -> DataFrame:
    """Verified (a, b) links between the keys of different texts, enough to connect each class.

    First the buckets are bands, and their members meet ``LEADERS`` leaders only, the texts that meet
    the most others over all bands: the middle of a group of copies. Where a band has more members
    than that compares, members not linked to its first leader are searched again, exactly, among the
    texts of these bands, in buckets of rare runs: first against the leaders of each bucket, which
    differ from bucket to bucket, then, where the links so far leave a bucket in parts, against all
    members of other parts. So of two similar texts that share a band none are lost; the work of
    the last search is linear in a bucket whose texts are connected and grows with the pairs between
    parts where they are not. Exact copies share a key and meet nobody.
    """
    representatives = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = stored(
        signed.where("key is not null").select("key", "weight", F.explode("bands").alias("bucket")).distinct(), "bands"
    )
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stored(members.join(sizes, "bucket"), "crowded")
    met = crowded.groupBy("key").agg(F.sum("n").alias("met"))
    leaders = stored(_led(crowded.join(met, "key"), [F.col("met").desc(), F.col("key")]), "leaders")
    candidates = stored(_candidates(crowded, leaders), "candidates")
    found = stored(verified(candidates, texts, representatives, common), "links")

    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wide = crowded.where(F.col("n") > LEADERS + 1)
    first = leaders.where("place = 1")
    settled = first.select("bucket", F.col("leader").alias("key")).union(
        first.join(both, first["leader"] == both["b"]).select("bucket", F.col("a").alias("key"))
    )
    open_members = stored(wide.join(settled, ["bucket", "key"], "left_anti").select("bucket", "key"), "open")
    again = wide.join(open_members.select("bucket").distinct(), "bucket", "left_semi").select("key").distinct()
    runs = text_runs(texts, representatives, again)
    rare = stored(rare_buckets(runs, common), "rare")
    open_keys = stored(open_members.select("key").distinct(), "open-keys")
    asking = rare.join(open_keys, "key", "left_semi").select("bucket").distinct()
    # Stored, so that the ranking below deals the buckets anew, with its first rows of each task alone.
    rare = stored(rare.join(asking, "bucket", "left_semi"), "asked")
    more = _candidates(rare, _led(rare, [F.xxhash64("key", "bucket")])).join(candidates, ["a", "b"], "left_anti")
    more = stored(more, "candidates")
    found = stored(found.union(verified(more, texts, representatives, common)), "links")
    compared = candidates.union(more)
    rest = stored(_between_classes(rare, open_keys, found).join(compared, ["a", "b"], "left_anti"), "candidates")
    return found.union(stored(verified(rest, texts, representatives, common), "links"))


def _classes(docs: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, mark, key, ...) per row of ``docs``, and (key, root, class_id, class_size) per text with words."""
    prepare_workers(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), F.col("text").cast("string").alias("text")
    )
    common = common_runs(texts)
    signed = stored(signatures(texts, common), "signatures")
    roots = components(links(texts, signed, common))
    by_key = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = by_key.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = stored(rooted, "rooted")
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    return signed, rooted.select("key", "root").join(classes, "root").select("key", "root", "class_id", "class_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size) per row of ``docs`` (doc_id, text, any other columns).

    A class is a connected component of the relation "weighted Jaccard similarity of the five-word
    runs is at least 0.8"; ``class_id`` is its least doc_id. Texts of the same words are always of
    one class. Null, empty and blank texts are classes of their own. A text of fewer than five
    words has one run of them all. Repeated rows are returned as often as they come and are of one
    class. A null doc_id gets its class's least doc_id (null if there is none); as class_size counts
    rows, a row without words has size 1. An empty table gives an empty table. The key of a word
    sequence has 64 bits: two different texts among n are taken as equal with probability n^2/2^65.
    """
    signed, of_key = _classes(docs, F.lit(0).cast("long"))
    return (
        signed.select("doc_id", "key")
        .join(of_key, "key", "left")
        .select(
            "doc_id",
            F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
        )
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class of ``near_duplicates``, with all its columns: that of the least doc_id.

    A row is told by its doc_id and a hash of all its values, so different texts under one doc_id,
    or without one, stay apart: each class keeps one row. A class keeps a row without a doc_id only
    if none of its rows has one; of rows with its least doc_id that of the least hash stays, and of
    equal rows one. Rows without words are classes of their own and stay, of equal ones one.
    """
    mark = row_mark(docs)
    signed, of_key = _classes(docs, mark)
    least = (
        signed.join(of_key, "key")
        .where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("root", "doc_id")
        .agg(F.min("mark").alias("mark"))
    )
    keepers = least.select("doc_id", "mark").union(signed.where("key is null").select("doc_id", "mark"))
    keepers = keepers.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark")).distinct()
    marked = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), mark.alias("_mark"))
    return marked.join(keepers, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select("_row.*")
