"""Fill-in-middle transformation by secondary sort: unit-chunk pieces, assembled in output order.

A text is cut into units (a run of ASCII letters, or one other character). Two of the unit borders,
drawn by a hash of the document's id, divide it into prefix, middle and suffix. No text is put
together in memory: every section is emitted as pieces of at most ``UNITS`` units keyed by
(document, output position); one shuffle by document sorts them inside their partitions
(``repartition`` and ``sortWithinPartitions``, the DataFrame form of
``repartitionAndSortWithinPartitions``), and the sorted pieces stream into an incremental digest or
into the output text. To restore the text, the stream is parsed by its marks alone, its pieces get
their place in the original as key and are sorted again where they are, which moves nothing.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import prepare_workers

#: Units and bytes of one piece at most; a longer unit is cut between code points.
UNITS = 8_192
PIECE_BYTES = 1 << 16

#: Percentages of the texts left as they are beyond ``FILLED``, and of suffix-first ones below ``SUFFIX_FIRST``.
FILLED, SUFFIX_FIRST = 90, 20
#: Rows and content bytes of one batch that a task hands on.
BATCH_ROWS, BATCH_BYTES = 4_000, 1 << 22
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKS = {PREFIX: b"<P>", MIDDLE: b"<M>", SUFFIX: b"<S>"}
#: Sections in output order.
ORDERS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The facts of a document stand before its output, and behind every section of its restored text.
FACTS, LAST = -1, 9

_LETTER = np.zeros(256, dtype=bool)
for _low, _high in (("A", "Z"), ("a", "z")):
    _LETTER[ord(_low) : ord(_high) + 1] = True


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which the units of UTF-8 ``data`` begin."""
    letter = _LETTER[data]
    start = letter | ((data & 0xC0) != 0x80)
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


class Plan(NamedTuple):
    """How one document is transformed; ``cuts`` are unit numbers."""

    n: int
    form: str
    cuts: tuple[int, int]


def plan(doc_id: int | None, text: bytes, n: int) -> Plan:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    plain = n == 0 or any(mark in text for mark in MARKS.values()) or h3 % 100 >= FILLED
    return Plan(n, "plain" if plain else "spm" if h4 % 100 < SUFFIX_FIRST else "psm", (first, second))


def _chunks(text: bytes, starts: np.ndarray, low: int, high: int) -> Iterator[bytes]:
    """The units ``low`` to ``high`` (exclusive) in pieces."""
    for first in range(low, high, UNITS):
        last = min(first + UNITS, high)
        at, end = int(starts[first]), int(starts[last]) if last < len(starts) else len(text)
        while at < end:
            stop = min(at + PIECE_BYTES, end)
            while stop < end and text[stop] & 0xC0 == 0x80:
                stop -= 1
            yield text[at:stop]
            at = stop


class Facts(NamedTuple):
    """What is known about a document besides its pieces."""

    doc_id: int | None
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output_sha256: str | None = None


class Record(NamedTuple):
    """A piece of a document, or its facts, keyed by its row (part, ordinal) and its place there."""

    part: int
    ordinal: int
    section: int
    position: int
    content: bytes
    facts: Facts | None = None


def pieces(part: int, rows: Iterable[tuple]) -> Iterator[Record]:
    """The records of the rows (doc_id, text) of one input partition, in output order."""
    for ordinal, (doc_id, text) in enumerate(rows):
        data = np.frombuffer(text, dtype=np.uint8)
        starts = unit_starts(data)
        made = plan(doc_id, text, len(starts))
        if made.form == "plain":
            prefix_chars = middle_chars = None
            sections = [(b"", 0, made.n)]
        else:
            at = [int(starts[c]) if c < made.n else len(text) for c in made.cuts]
            chars = (data & 0xC0) != 0x80
            prefix_chars, middle_chars = int(chars[: at[0]].sum()), int(chars[at[0] : at[1]].sum())
            units = {PREFIX: (0, made.cuts[0]), MIDDLE: made.cuts, SUFFIX: (made.cuts[1], made.n)}
            sections = [(MARKS[s], *units[s]) for s in ORDERS[made.form]]
        yield Record(part, ordinal, FACTS, 0, b"", Facts(doc_id, made.n, made.form, prefix_chars, middle_chars))
        position = itertools.count()
        for mark, low, high in sections:
            # The mark goes in front of its section's first piece.
            for chunk in _chunks(text, starts, low, high):
                yield Record(part, ordinal, 0, next(position), mark + chunk)
                mark = b""
            if mark:
                yield Record(part, ordinal, 0, next(position), mark)


class Sections:
    """Divides a streamed output by its marks: what comes out are (section, bytes), in output order.

    A mark may lie across two pieces. As the text holds no mark and a mark can begin and end nowhere
    but at its own brackets, the first mark of a kind found is the one that was put in.
    """

    def __init__(self, form: str):
        self.ahead = list(ORDERS[form])
        self.section = PREFIX
        self.kept = b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        piece = self.kept + piece
        self.kept = b""
        while self.ahead:
            mark = MARKS[self.ahead[0]]
            at = piece.find(mark)
            if at < 0:
                hold = len(mark) - 1
                piece, self.kept = piece[:-hold], piece[-hold:]
                break
            if at:
                yield self.section, piece[:at]
            piece, self.section = piece[at + len(mark) :], self.ahead.pop(0)
        if piece:
            yield self.section, piece

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.ahead:
            raise ValueError("an output that lacks one of its marks")
        if self.kept:
            yield self.section, self.kept


def restored_text(output: bytes, form: str) -> bytes:
    """The text of one whole output, from output and form alone."""
    parser = Sections(form)
    found = [*parser.feed(output), *parser.rest()]
    return b"".join(piece for _, piece in sorted(found, key=lambda x: x[0]))


_KEYS = (("part", pa.int64()), ("ordinal", pa.int64()), ("section", pa.int64()), ("position", pa.int64()), ("content", pa.binary()))
_FACTS = (
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()),
)
RECORDS = (
    "part long, ordinal long, section long, position long, content binary, "
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
)
_NO_FACTS = (None,) * len(_FACTS)


def _batches(rows: Iterator[tuple], columns: tuple, content: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches; ``content`` is the place of the column whose bytes count."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        values = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns, strict=True)], names=[n for n, _ in columns])

    for row in rows:
        held.append(row)
        size += 0 if content is None else len(row[content])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _records(found: Iterator[Record]) -> Iterator[pa.RecordBatch]:
    return _batches(((*r[:5], *(r.facts or _NO_FACTS)) for r in found), _KEYS + _FACTS, content=4)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """Sorted records, document by document, as streams of (content, facts or None)."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True))
    for document, found in itertools.groupby(rows, key=lambda row: row[:2]):
        # The number of units is set in facts alone.
        yield document, ((row[4], None if row[6] is None else Facts(*row[5:])) for row in found)


def sorted_pieces(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The records of all documents, those of one input row together and in output order.

    The rows of ``docs`` are told apart by partition and place in it, so that many rows of one id or
    text are many small documents; ``docs`` should be read from files or a stored table, whose
    partitions are the same whenever a task is repeated. The sort runs outside Python and spills.
    """
    prepare_workers(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (doc_id, (text.as_py() or "").encode("utf-8", "replace"))
            for batch in batches
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
        )
        return _records(pieces(TaskContext.get().partitionId(), rows))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(cut, RECORDS)
    keys = ("part", "ordinal")
    dealt = found.repartition(*keys) if partitions is None else found.repartition(partitions, *keys)
    return dealt.sortWithinPartitions(*keys, "section", "position")


OUTPUT_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def outputs(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The transformed documents: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty; empty texts, and
    texts with a mark of their own, stay as they are (form ``plain``, no section lengths). A null
    doc_id counts as the empty id. Repeated rows are transformed alike, each on its own; an empty
    table gives an empty table. A task holds one output text at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple]:
            for _, records in _documents(batches):
                _, facts = next(records)
                yield (*facts[:5], b"".join(content for content, _ in records))

        columns = (*_FACTS[:5], ("output", pa.binary()))
        for batch in _batches(texts(), columns, content=5):
            yield batch.set_column(5, "output", batch.column(5).cast(pa.string()))

    return sorted_pieces(docs, partitions).mapInArrow(joined, OUTPUT_SCHEMA)


def _output_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the outputs, and their pieces keyed by their place in the original text."""

    def placed() -> Iterator[Record]:
        for document, records in _documents(batches):
            _, facts = next(records)
            digest, parser, number = hashlib.sha256(), Sections(facts.form), itertools.count()
            for content, _ in records:
                digest.update(content)
                for section, found in parser.feed(content):
                    yield Record(*document, section, next(number), found)
            for section, found in parser.rest():
                yield Record(*document, section, next(number), found)
            yield Record(*document, LAST, 0, b"", facts._replace(output_sha256=digest.hexdigest()))

    return _records(placed())


def _restored_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests_of() -> Iterator[tuple]:
        for _, records in _documents(batches):
            digest = hashlib.sha256()
            for content, facts in records:
                if facts is None:
                    digest.update(content)
                else:
                    yield (*facts, digest.hexdigest())

    return _batches(digests_of(), (*_FACTS, ("restored_sha256", pa.string())))


DIGEST_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Like ``outputs`` with the digests of the output and of the text restored from it, in streams.

    No task of the assembly holds a document: pieces go through the digests one by one, and a task's
    memory is that of its batches. The rows and cases are those of ``outputs``.
    """
    again = sorted_pieces(docs, partitions).mapInArrow(_output_digests, RECORDS)
    return again.sortWithinPartitions("part", "ordinal", "section", "position").mapInArrow(_restored_digests, DIGEST_SCHEMA)
