"""Packing by power-of-two decomposition.

Every document's tokens are cut into pieces of power-of-two lengths: as many full sequences as fit,
then the binary digits of the rest, longest first. A piece is a sequence of its own, so no sequence
crosses documents and none needs padding; sequences of equal length form a bucket and batch together.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .storage import prepare_workers

CAPACITY = 4_096
END_ID = 2
#: Words whose ids a worker remembers (some 200 bytes each), and bytes of a word that it keeps when that is full.
REMEMBERED, SHORT_WORD = 1_000_000, 7
#: Bytes of ids in one output batch.
OUTPUT_BYTES = 8 * 1024 * 1024

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def public_tokenizer() -> str:
    """The default vocabulary file, looked up on the machine that tokenizes."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    Where the tokenizer drops white space, never joins across it and folds ASCII case, a text's ids
    are its lower-case words' ids in order, and each word is tokenized once and remembered. Any
    other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = ids(" Ab\n cD, é.\t\r") == ids("ab") + ids("cd,") + ids("é.")

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(encoding.ids, dtype="<u4").tobytes() for encoding in found]

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._encode([text])[0]
        # Names of special tokens are matched by case; bytes.lower changes ASCII letters only.
        parts = (text if b"<|" in text else text.lower()).split()
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                # Short words come back; of the long ones most are seen once.
                self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT_WORD}
                new = set(parts).difference(self.known)
            self.known.update(zip(new, self._encode(list(new)), strict=True))
        return b"".join(map(self.known.__getitem__, parts))


#: One per vocabulary file in each Python worker, for all the tasks that the worker runs.
_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the binary digits of the rest from the highest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << i for i in range(capacity.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A document's ids are those of its whole
    text, then ``end_id``; null and empty texts have ``end_id`` alone. ``ids`` holds little-endian
    unsigned 32-bit integers. ``capacity`` must be a power of two; sequences are at most as long.
    Nothing is shuffled: each document is cut where it is read, and ``sequence_id`` numbers the
    pieces by input partition. Repeated rows and null doc_ids give pieces of their own; an empty
    table gives an empty table.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    prepare_workers(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path or public_tokenizer())
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

        for batch in batches:
            t = W.texts(batch.column("text"))
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), t.start.tolist(), t.end.tolist(), strict=True):
                ids = ids_of(t.data[lo:hi].tobytes()) + end
                tokens, start = len(ids) // 4, 0
                for length in piece_lengths(tokens, capacity):
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens))
                    start += length
                    held += 4 * length
                    if held >= OUTPUT_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, SCHEMA)
    return (
        pieces.withColumn("bucket", F.col("length"))
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def batches(pieces: DataFrame, tokens: int = 1 << 20, parts: int = 1_024) -> DataFrame:
    """Adds ``batch``: sequences of equal length in groups of at most ``tokens`` tokens.

    A bucket is dealt over ``parts`` hash parts first, so that one very common length is not one
    task's work; the batches of a part are numbered on their own: (bucket, part, batch) names one.
    """
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "sequence_id"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("sequence_id")) - 1
    return dealt.withColumn("batch", F.floor(place * F.col("bucket") / F.lit(tokens)).cast("long"))


