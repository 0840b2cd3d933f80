"""Quality rules: base counts, and the divergence of a document from language references.

A document is compared with each language's reference in two histograms: its characters by class,
and its words over the language's common words plus "any other word". The distance is the
Jensen-Shannon distance (base 2, 0 to 1). A document is near a language when both distances are
within that language's limits, and passes when it is near one language. Texts too short for
a histogram to say anything pass that histogram (minimum-length guards).

References are counted over all documents with a language: characters and words of every whole
text, except of documents that already fail the base rules. The limits are fixed parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import prepare_workers, stored

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A word is common in a language when it makes up at least this share of its words: at most 1/share words per language.
COMMON_SHARE = 0.004
#: Words of one block of the first counting pass.
BLOCK_WORDS = 200_000
#: Guards: characters other than white space, and words, below which a histogram is not judged.
MIN_CHARS, MIN_HISTOGRAM_WORDS = 100, 50
#: Limits of the distances.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.40

SYMBOLS = b"#*$%&|<>"
#: Classes of the bytes of UTF-8 text: a character of several bytes counts by its lead byte alone.
CLASSES = ("lower", "upper", "digit", "sentence", "other", "symbol", "latin", "foreign")
_SKIP = 8


def _byte_classes() -> np.ndarray:
    table = np.full(256, _SKIP, dtype=np.uint8)  # white space and control characters, continuation bytes
    for b in range(33, 127):
        table[b] = CLASSES.index("other")
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[list(b".,;:?'\"-()")] = CLASSES.index("sentence")
    table[list(SYMBOLS)] = CLASSES.index("symbol")
    table[0xC2:0xCA] = CLASSES.index("latin")  # U+0080 to U+027F: accented Latin letters for the most part
    table[0xCA:0xF5] = CLASSES.index("foreign")
    return table


_CLASS_OF = _byte_classes()
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


class Base(NamedTuple):
    """Counts of every row of a block."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense codes of pairs of dense codes: equal pairs, and only they, get equal codes."""
    width = int(b.max()) + 1 if len(b) else 1
    return pd.factorize(a.astype(np.int64) * width + b)[0]


def repeated_words(block: W.Words) -> np.ndarray:
    """Words of each row that lie in a window of ``REPEAT_WINDOW`` words found twice or more in the row.

    Windows are compared through codes of runs of 1, 2, 4 and 8 words, which are exact given the
    words' 64-bit hashes.
    """
    n = W.counts(block)
    out = np.zeros(len(n), dtype=np.int64)
    size = len(block.hash)
    if size < REPEAT_WINDOW:
        return out
    code = pd.factorize(block.hash)[0]
    step = 1
    while step < REPEAT_WINDOW:
        code = _codes(code[:-step], code[step:])
        step *= 2
    starts = np.flatnonzero(block.row[: size - REPEAT_WINDOW + 1] == block.row[REPEAT_WINDOW - 1 :])
    window = _codes(code[starts], block.row[starts] - block.first)
    twice = starts[np.bincount(window)[window] > 1] if len(window) else starts
    covered = np.zeros(size + 1, dtype=np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + REPEAT_WINDOW, -1)
    inside = np.cumsum(covered)[:size] > 0
    return np.bincount(block.row[inside] - block.first, minlength=len(n))


def duplicate_lines(t: W.Texts, block: W.Words) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of the row."""
    n = np.zeros(block.last - block.first, dtype=np.int64)
    low, high = int(t.start[block.first]), int(t.end[block.last - 1])
    breaks = np.flatnonzero(t.data[low:high] == 10) + low
    if not len(breaks):
        return n
    first, last = np.searchsorted(breaks, t.start[block.first : block.last]), np.searchsorted(breaks, t.end[block.first : block.last])
    for i in np.flatnonzero(last > first):
        text = t.data[t.start[block.first + i] : t.end[block.first + i]].tobytes()
        lines = [line for line in text.split(b"\n") if not line.isspace() and line]
        n[i] = len(lines) - len(set(lines))
    return n


def base_counts(t: W.Texts, block: W.Words) -> Base:
    low, high = int(t.start[block.first]), int(t.end[block.last - 1])
    data = t.data[low:high]
    start, end = t.start[block.first : block.last] - low, t.end[block.first : block.last] - low
    kind = _CLASS_OF[data]
    classes = np.stack([W.range_sums(kind == i, start, end) for i in range(len(CLASSES))], axis=1)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[block.end - low] - points[block.start - low]
    n = W.counts(block)
    return Base(
        n,
        np.bincount(block.row - block.first, weights=chars, minlength=len(n)).astype(np.int64),
        W.range_sums(_IS_SYMBOL[data], start, end),
        duplicate_lines(t, block),
        repeated_words(block),
        classes,
    )


def base_failed(base: Base) -> np.ndarray:
    return (base.n_words < MIN_WORDS) | (100 * base.n_repeat_words > MAX_REPEAT_PERCENT * base.n_words)




class References(NamedTuple):
    """Per language: shares of the character classes, and hashes and shares of the common words."""

    languages: list[str]
    classes: np.ndarray
    common: np.ndarray  # sorted hashes over all languages
    shares: np.ndarray  # (languages, len(common)); 0 where the word is not common in the language


def _language_blocks(batch: pa.RecordBatch) -> Iterator[tuple[W.Texts, W.Words, Base, np.ndarray]]:
    t = W.texts(batch.column("text"))
    lang = np.array(batch.column("lang").to_pylist(), dtype=object)
    for block in W.blocks(t):
        base = base_counts(t, block)
        yield t, block, base, np.where(base_failed(base), None, lang[block.first : block.last])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character classes and words per language, and words in half the common share of a block of words.

    Rows (lang, item, n, block): item null and block the class number for classes (-1: words).
    """
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    classes: dict[str, np.ndarray] = {}
    words: dict[str, int] = {}
    out: list[tuple] = []

    def flush(lang: str) -> None:
        ids, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        total = size.pop(lang)
        keep = n >= COMMON_SHARE / 2 * total
        out.extend((lang, i, c, total) for i, c in zip(ids[keep].astype(np.int64).tolist(), n[keep].tolist(), strict=True))

    for batch in batches:
        for _, block, base, langs in _language_blocks(batch):
            for lang in {x for x in langs if x is not None}:
                rows = langs == lang
                classes[lang] = classes.get(lang, 0) + base.classes[rows].sum(axis=0)
                words[lang] = words.get(lang, 0) + int(base.n_words[rows].sum())
                mine = block.hash[rows[block.row - block.first]]
                held.setdefault(lang, []).append(mine)
                size[lang] = size.get(lang, 0) + len(mine)
                if size[lang] >= BLOCK_WORDS:
                    flush(lang)
    for lang in list(held):
        flush(lang)
    for lang, n in classes.items():
        out.extend((lang, None, c, i) for i, c in enumerate(n.tolist()))
        out.append((lang, None, words[lang], -1))
    if out:
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["lang", "item", "n", "block"]
        )


def references(docs: DataFrame) -> References:
    """Language references counted over all documents, exactly, in two passes.

    A common word reaches the share in at least one block of words; the first pass names the words
    that reach half the share in a block. Those whose named counts plus half the share of all other
    blocks can reach the share are counted in the second pass: at most 2 / COMMON_SHARE words per
    language, whatever the number of documents, and only they and one row per language and class
    reach the driver.
    """
    texts = docs.select("text", "lang")
    # A few hundred rows for each block and language, read three times below.
    first = stored(texts.mapInArrow(_totals, "lang string, item long, n long, block long"), "totals")
    totals = first.where("item is null").groupBy("lang", "block").agg(F.sum("n").alias("n"))
    sizes = totals.where("block = -1").select("lang", F.col("n").alias("total"))
    named = (
        first.where("item is not null").groupBy("lang", "item").agg(F.sum("n").alias("n"), F.sum("block").alias("block"))
        .join(sizes, "lang").where(F.col("n") + COMMON_SHARE / 2 * (F.col("total") - F.col("block")) >= COMMON_SHARE * F.col("total"))
        .select("lang", F.col("item").alias("block"), F.lit(None).cast("long").alias("n"))
    )
    both = totals.select("lang", "block", "n").union(named).toPandas()
    counted = both[both.n.notna()]
    languages = sorted(counted.lang.unique())
    place = {lang: i for i, lang in enumerate(languages)}
    classes, words = np.zeros((len(languages), len(CLASSES))), np.zeros(len(languages))
    for lang, kind, n in counted.itertuples(index=False):
        if kind == -1:
            words[place[lang]] = n
        else:
            classes[place[lang], int(kind)] = n
    wanted = np.unique(both[both.n.isna()].block.to_numpy().astype(np.int64).astype(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(languages), len(wanted)), dtype=np.int64)
        for batch in batches:
            for _, block, _, langs in _language_blocks(batch):
                at = np.searchsorted(wanted, block.hash)
                hit = at < len(wanted)
                hit[hit] = wanted[at[hit]] == block.hash[hit]
                number = np.array([place.get(x, -1) if x is not None else -1 for x in langs])[block.row[hit] - block.first]
                known = number >= 0
                np.add.at(n, (number[known], at[hit][known]), 1)
        lang, item = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(item), pa.array(n[lang, item])], names=["lang", "item", "n"])

    shares = np.zeros((len(languages), len(wanted)))
    if len(wanted):
        for lang, item, n in texts.mapInArrow(count, "lang long, item long, n long").groupBy("lang", "item").agg(F.sum("n")).collect():
            shares[lang, item] = n / words[lang]
    shares[shares < COMMON_SHARE] = 0
    used = shares.any(axis=0)
    return References(languages, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), wanted[used], shares[:, used])


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` and of ``q`` (both sum to 1, or ``p`` is all zero)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def distances(refs: References, block: W.Words, base: Base) -> tuple[np.ndarray, np.ndarray]:
    """Character and word distances of every row of the block to every language: (rows, languages)."""
    chars = base.classes.sum(axis=1)
    p = base.classes / np.maximum(chars, 1)[:, None]
    by_char = np.stack([_distance(p, q) for q in refs.classes], axis=1)
    at = np.searchsorted(refs.common, block.hash)
    hit = at < len(refs.common)
    hit[hit] = refs.common[at[hit]] == block.hash[hit]
    width = len(refs.common)
    seen = np.bincount((block.row[hit] - block.first) * width + at[hit], minlength=len(chars) * width).reshape(len(chars), width) if width else np.zeros((len(chars), 0))
    share = seen / np.maximum(base.n_words, 1)[:, None]
    by_word = []
    for q in refs.shares:
        mine = share[:, q > 0]
        other = np.clip(1 - mine.sum(axis=1, keepdims=True), 0, 1)
        by_word.append(_distance(np.hstack([mine, other]), np.append(q[q > 0], max(0.0, 1 - q.sum()))))
    return by_char, np.stack(by_word, axis=1)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, language string, char_distance double, word_distance double"
)


def verdicts(refs: References, column: pa.Array) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` from ``n_words`` on, for the texts of ``column``."""
    t = W.texts(column)
    parts = []
    for block in W.blocks(t):
        base = base_counts(t, block)
        failed = base_failed(base)
        if refs.languages:
            by_char, by_word = distances(refs, block, base)
            short_chars = (base.classes.sum(axis=1) < MIN_CHARS)[:, None]
            short_words = (base.n_words < MIN_HISTOGRAM_WORDS)[:, None]
            near = (short_chars | (by_char <= MAX_CHAR_DISTANCE)) & (short_words | (by_word <= MAX_WORD_DISTANCE))
            best = (by_char + by_word).argmin(axis=1)
            rows = np.arange(len(best))
            found = (near.any(axis=1), np.array(refs.languages, dtype=object)[best], by_char[rows, best], by_word[rows, best])
        else:
            empty = np.full(len(failed), None, dtype=object)
            found = (np.ones(len(failed), bool), empty, empty, empty)
        parts.append((*base[:5], failed, ~failed & found[0], *found[1:]))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 10


def judged(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """Counts and verdict of every whole text of ``docs`` (doc_id, text, lang and any other columns).

    ``language`` is the nearest reference by the sum of both distances, with its distances. Null and
    blank texts have no words and fail the base rules. Documents without a language, or of one
    without words, add nothing to the references; without any reference the base rules decide
    alone. Repeated rows are judged one by one and count one by one. An empty table gives an empty
    table.
    """
    prepare_workers(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    refs = references(texts) if refs is None else refs

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
        for batch in batches:
            columns = verdicts(refs, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return texts.drop("lang").mapInArrow(judge, SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; see ``judged``."""
    prepare_workers(docs.sparkSession)
    refs = references(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(refs, batch.column("text"))[6], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
