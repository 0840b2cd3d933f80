"""Language identification: script ranges, per-word scores and a Viterbi path over a text's words.

Per language a table holds the log probabilities of the byte trigrams of its words (hashed to
``TABLE`` slots). A word's score in a language is the sum over its trigrams, relative to the best
language and at least ``-WORST``; languages that do not use the script of the word's first letter
are out of the running for it, and a word without a letter says nothing. The path that maximises
the words' scores, less ``SWITCH`` for every change of language, labels spans of mixed text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import prepare_workers

TABLE = 1 << 16
SMOOTHING = 0.1
WORST = 6.0
SWITCH = 12.0
#: A language uses a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Documents with a smaller certain share are rejected by ``certain_documents``.
MIN_SCORE = 0.35
#: Words of one piece of a path; pieces are computed side by side and joined.
PIECE = 64
UNDETERMINED = "und"

#: Code point ranges of scripts (fixed values of the Unicode blocks); letters outside are script 0.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x531, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
)
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_LOW = np.array(sorted(low for _, low, _ in SCRIPTS))
_BY_LOW = {low: (NAMES.index(name), high) for name, low, high in SCRIPTS}
_HIGH = np.array([_BY_LOW[low][1] for low in _LOW])
_SCRIPT = np.array([_BY_LOW[low][0] for low in _LOW])
#: Whether a code point is a letter (Unicode categories L*).
_IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[W.SPACE] = 32


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the letters' first bytes in UTF-8 ``data`` and their scripts' numbers."""
    ascii_letter = ((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z")) & (data < 128)
    at = np.flatnonzero(ascii_letter)
    script = np.full(len(at), NAMES.index("latin"), dtype=np.int64)
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return at, script
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (padded[lead + i] for i in range(4))
    point = np.where(
        b0 < 0xE0, (b0 & 0x1F) << 6 | (b1 & 0x3F),
        np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | (b2 & 0x3F), (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | (b3 & 0x3F)),
    )
    letter = _IS_LETTER[np.minimum(point, 0x10FFFF)]
    lead, point = lead[letter], point[letter]
    place = np.searchsorted(_LOW, point, "right") - 1
    inside = (place >= 0) & (point <= _HIGH[place])
    return np.concatenate([at, lead]), np.concatenate([script, np.where(inside, _SCRIPT[place], 0)])


class Block(NamedTuple):
    """What scoring needs of a block: trigram slot at every byte, script (-1: no letter) of every word."""

    low: int
    slot: np.ndarray
    script: np.ndarray


def _block(t: W.Texts, words: W.Words) -> Block:
    low, high = int(t.start[words.first]), int(t.end[words.last - 1])
    data = t.data[low:high]
    b = _LOWER[data]
    # A word's first and last trigram reach over its edges; what stands there counts as a blank.
    edge = np.zeros(len(b) + 2, dtype=bool)
    edge[words.start - low] = True
    before = np.concatenate([[32], b[:-1]]).astype(np.uint32) if len(b) else b
    before[edge[: len(b)]] = 32
    after = np.concatenate([b[1:], [32]]).astype(np.uint32) if len(b) else b
    if len(words.end):
        after[words.end - low - 1] = 32
    code = (before << np.uint32(16)) | (b << np.uint32(8)) | after
    slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    script = np.full(len(words.start), -1, dtype=np.int64)
    at, kind = code_points(data)
    if len(at) and len(script):
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
        first = np.searchsorted(at, words.start - low)
        has = first < len(at)
        has[has] = at[first[has]] < (words.end - low)[has]
        script[has] = kind[first[has]]
    return Block(low, slot, script)


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # (languages, TABLE)
    uses: np.ndarray  # (languages, scripts)


def is_held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        t = W.texts(batch.column("text"))
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        for words in W.blocks(t):
            block = _block(t, words)
            ends = t.end[words.first : words.last] - block.low
            inside = np.zeros(len(block.slot) + 1, dtype=np.int64)
            inside[words.start - block.low] += 1
            inside[words.end - block.low] -= 1
            inside = np.cumsum(inside)[:-1] > 0
            row = np.searchsorted(ends, np.arange(len(block.slot)), "right")
            mine = lang[words.first : words.last]
            for name in set(mine):
                rows = mine == name
                n = np.bincount(block.slot[inside & rows[np.minimum(row, len(rows) - 1)]], minlength=TABLE)
                slots[name] = slots.get(name, 0) + n
                known = block.script[rows[words.row - words.first]]
                scripts[name] = scripts.get(name, 0) + np.bincount(known[known >= 0], minlength=len(NAMES))
    for name in slots:
        for kind, n in ((0, slots[name]), (1, scripts[name])):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(np.full(len(some), kind)), pa.array(some), pa.array(n[some])],
                names=["lang", "kind", "item", "n"],
            )


def train(labelled: DataFrame) -> Model:
    """Trigram and script tables counted over all of ``labelled`` (text, lang), rows without lang left out.

    What reaches the driver is one count per language and table slot at most.
    """
    prepare_workers(labelled.sparkSession)
    counted = (
        labelled.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .mapInArrow(_count, "lang string, kind long, item long, n long")
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow()
    )
    names = np.array(counted["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names))
    number = np.array([languages.index(x) for x in names], dtype=np.int64)
    kind, item, n = (counted[c].to_numpy() for c in ("kind", "item", "n"))
    tables = np.full((len(languages), TABLE), SMOOTHING)
    tables[number[kind == 0], item[kind == 0]] += n[kind == 0]
    scripts = np.zeros((len(languages), len(NAMES)))
    scripts[number[kind == 1], item[kind == 1]] = n[kind == 1]
    log_p = np.log(tables / tables.sum(axis=1, keepdims=True))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, log_p.astype(np.float32), uses)


def word_scores(model: Model, words: W.Words, block: Block) -> np.ndarray:
    """(words, languages): at most 0, the best language at 0, ``-WORST`` at the worst."""
    begin, end = words.start - block.low, words.end - block.low
    out = np.empty((len(begin), len(model.languages)))
    total = np.zeros(len(block.slot) + 1)
    for i, table in enumerate(model.log_p):
        np.cumsum(table[block.slot], out=total[1:])
        out[:, i] = total[end] - total[begin]
    candidate = model.uses[:, np.maximum(block.script, 0)].T
    none = ~candidate.any(axis=1) | (block.script < 0)
    out[~candidate] = -np.inf
    out[none] = 0
    out -= out.max(axis=1, keepdims=True)
    return np.maximum(out, -WORST)


def best_path(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of every word on the best path of its row; rows of ``sizes`` words follow each other.

    Rows are cut into pieces of ``PIECE`` words. For every piece the best score from each entering to
    each leaving language is found, all pieces at once; pieces are chained row by row; then every
    piece is walked again from its now known start, and back. The result is that of one plain pass.
    """
    n_lang = scores.shape[1]
    pieces = -(-sizes // PIECE)
    first_piece = np.concatenate([[0], np.cumsum(pieces)])
    n = int(first_piece[-1])
    if not n:
        return np.zeros(0, dtype=np.int64)
    row_of_piece = np.repeat(np.arange(len(sizes)), pieces)
    place = np.arange(n) - first_piece[row_of_piece]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    piece_of_word = np.repeat(first_piece[:-1], sizes) + (np.arange(len(scores)) - np.repeat(starts[:-1], sizes)) // PIECE
    step_of_word = (np.arange(len(scores)) - np.repeat(starts[:-1], sizes)) % PIECE
    x = np.zeros((PIECE, n, n_lang))
    x[step_of_word, piece_of_word] = scores

    deepest = int(place.max())
    enter = np.zeros((n, n_lang))
    if deepest:
        through = np.where(np.eye(n_lang, dtype=bool), 0.0, -np.inf) + np.zeros((n, 1, 1))
        for s in x:
            np.maximum(through, through.max(axis=2, keepdims=True) - switch, out=through)
            through += s[:, None, :]
        for k in range(1, deepest + 1):
            here = np.flatnonzero(place == k)
            enter[here] = (enter[here - 1][:, :, None] + through[here - 1]).max(axis=1)
            enter[here] -= enter[here].max(axis=1, keepdims=True)

    stay = np.empty((PIECE, n, n_lang), dtype=bool)
    jump = np.empty((PIECE, n), dtype=np.int64)
    d = enter.copy()
    for i, s in enumerate(x):
        jump[i] = d.argmax(axis=1)
        moved = d[np.arange(n), jump[i]] - switch
        stay[i] = d >= moved[:, None]
        d = np.maximum(d, moved[:, None]) + s

    pick = np.arange(n)
    back = np.tile(np.arange(n_lang), (n, 1))  # language before the piece, by language at its end
    for i in range(PIECE - 1, -1, -1):
        back = np.where(stay[i][pick[:, None], back], back, jump[i][:, None])
    leave = np.zeros(n, dtype=np.int64)
    last = first_piece[1:][pieces > 0] - 1
    leave[last] = d[last].argmax(axis=1)
    for k in range(deepest, 0, -1):
        here = np.flatnonzero(place == k)
        leave[here - 1] = back[here, leave[here]]
    label = np.empty((PIECE, n), dtype=np.int64)
    state = leave
    for i in range(PIECE - 1, -1, -1):
        label[i] = state
        state = np.where(stay[i][pick, state], state, jump[i])
    return label[step_of_word, piece_of_word]


SPANS = "array<struct<first_word: long, words: long, lang: string>>"


def _spans(model: Model, path: np.ndarray, sizes: np.ndarray) -> pa.Array:
    row = np.repeat(np.arange(len(sizes)), sizes)
    new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])])) if len(path) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = np.bincount(row[new], minlength=len(sizes))
    values = pa.StructArray.from_arrays(
        [
            pa.array(new - starts[row[new]]),
            pa.array(np.diff(np.append(new, len(path)))),
            pa.array([model.languages[i] for i in path[new]], pa.string()),
        ],
        names=["first_word", "words", "lang"],
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)


def _certain_words(scores: np.ndarray, path: np.ndarray, row: np.ndarray, lettered: np.ndarray, rows: int) -> np.ndarray:
    """(rows, languages): words with letters on the path, each as much as its span's words alone point to the span's language.

    A span is judged by its own words, so a second language takes nothing from the first, however long the text.
    """
    out = np.zeros((rows, scores.shape[1]))
    if len(path):
        new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])]))
        totals = np.add.reduceat(scores, new, axis=0)
        chance = np.exp(totals - totals.max(axis=1, keepdims=True))
        chance = chance[np.arange(len(new)), path[new]] / chance.sum(axis=1)
        np.add.at(out, (row[new], path[new]), chance * np.add.reduceat(lettered.astype(np.int64), new))
    return out


def labelled(model: Model, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Block by block of the texts of ``column``: number of the first row, languages, scores, certain shares, spans."""
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    t = W.texts(column)
    for words in W.blocks(t):
        sizes = W.counts(words)
        block = _block(t, words)
        lettered = block.script >= 0
        row = words.row - words.first
        n_lettered = np.bincount(row[lettered], minlength=len(sizes))
        if model.languages:
            scores = word_scores(model, words, block)
            path = best_path(scores, sizes)
            votes = np.zeros((len(sizes), len(model.languages)))
            np.add.at(votes, (row[lettered], path[lettered]), 1)
            totals = np.stack([np.bincount(row, weights=s, minlength=len(sizes)) for s in scores.T], axis=1)
            chance = np.exp(totals - totals.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best = (votes + chance * 0.5).argmax(axis=1)
            rows = np.arange(len(sizes))
            sure = _certain_words(scores, path, row, lettered, len(sizes)) / np.maximum(n_lettered, 1)[:, None]
            best = np.where(n_lettered > 0, best, len(model.languages))
            score = np.where(n_lettered > 0, sure[rows, np.minimum(best, len(model.languages) - 1)], 0.0)
            certain = np.where(n_lettered > 0, sure.sum(axis=1), 0.0)
        else:
            best, score, path = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(0, np.int64)
            certain, sizes = np.zeros(len(sizes)), np.zeros_like(sizes)
        yield words.first, names[best], score, certain, _spans(model, path, sizes)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every whole text of ``docs`` (doc_id, text, others ignored).

    ``lang_pred`` is the language of most words with letters on the best path (ties: the higher
    total score, then the first by name); ``score`` their share, each span counted by the probability
    of the language given the span's words. Texts that are null or have no letter, and all texts if the model has
    no language, are ``und`` with score 0; their spans are empty. Words of scripts that no learned
    language uses follow their neighbours. Repeated rows get equal results; an empty table gives an
    empty table.
    """
    prepare_workers(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lang, score, _, spans in labelled(model, batch.column("text")):
                ids = batch.column("doc_id").slice(first, len(lang))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lang, pa.string()), pa.array(score), spans], names=["doc_id", "lang_pred", "score", "spans"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(label, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def certain_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, any others) in a language that was learned from their labels, with all their columns.

    Texts without a letter go, and texts whose words, each counted by the probability of its span's
    language given the span's words, are certain in a share below ``MIN_SCORE``: their spans do not
    tell the languages apart. Texts of several languages stay, whatever their length. Without any labelled row nothing can be learned
    and only texts without a letter go.
    """
    model = train(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lang, _, sure, _ in labelled(model, batch.column("text")):
                certain = (sure >= MIN_SCORE) & (lang != UNDETERMINED)
                yield batch.slice(first, len(lang)).filter(pa.array(certain if model.languages else _lettered(batch, first, len(lang)), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _lettered(batch: pa.RecordBatch, first: int, size: int) -> np.ndarray:
    return np.array([any(map(str.isalpha, x.as_py() or "")) for x in batch.column("text").slice(first, size)], dtype=bool)
