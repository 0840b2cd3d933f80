"""Multi-line CSV read in parallel, however few files it comes in.

A quoted value may hold line breaks, so no block of a file tells by itself whether it begins inside a
record. What tells is the number of quotation marks before it: it is odd inside a quoted value, and a
doubled mark leaves it as it is. Spark reads the files as lines, block by block. A first pass counts
the marks of every block, a running sum over the blocks of a file says which ones begin inside a
value, and then every block finds its records alone. A record that lies across blocks comes out in
fragments, which are put together by a small shuffle; all other records stay where they were read.
"""

from __future__ import annotations

import csv
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of what a block yields: a whole record, the end of one begun earlier, the begin of one, or a block inside one.
WHOLE, TAIL, HEAD, INNER = range(4)

#: Bytes of the files that one task reads where the session's blocks are smaller, and the least number of tasks per core.
TASK_BYTES = 1 << 25
TASKS_PER_CORE = 4

_SCHEMA = "file long, block long, kind int, record string"
_NOTHING = pa.array([], pa.string())


def _tasks(spark: SparkSession, path: str) -> int:
    """The number of tasks in which the blocks below ``path`` are read; the files are listed, not opened."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of every block in their order, with the carriage return of their end, if any.

    A task reads many blocks, one after the other: to start a task and its Python worker takes longer than a small block.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    named = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return named.coalesce(_tasks(spark, path))


def inside_blocks(lines: DataFrame, quote: str = '"') -> tuple[set[tuple[int, int]], set[int]]:
    """The blocks that begin inside a quoted value, and the files whose marks do not pair up.

    One number per block is added up where the lines are read; only keys of blocks reach the driver,
    and only of those that begin inside a value.
    """
    marks = F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote))))
    blocks = lines.groupBy("file", "block").agg(marks.alias("marks"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = blocks.select("file", "block", (F.sum("marks").over(before) % 2).alias("odd"), (F.sum("marks").over(Window.partitionBy("file")) % 2).alias("open"))
    found = known.where("odd = 1 or open = 1").collect()
    return {(r.file, r.block) for r in found if r.odd == 1}, {r.file for r in found if r.open == 1}


class UnpairedQuotes(ValueError):
    """A file with an odd number of quotation marks: where its quoted values end cannot be told by counting."""


def _joined(lines: list[pa.Array], borders: np.ndarray) -> pa.Array:
    """The texts of the lines from each border to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.concat_arrays(lines)), "\n")


class _Block:
    """Turns the lines of one block, coming in batches, into its whole records or, with ``fragments``, what it has of others.

    Lines stay in Arrow. A record ends with every line after which no value is open.
    """

    def __init__(self, file: int, block: int, inside: bool, quote: str, names: list[str], fragments: bool):
        self.file, self.block, self.quote, self.fragments = file, block, quote, fragments
        # The first record of a file names its columns and goes no further.
        self.header = names if block == 0 and not fragments else None
        self.odd, self.begun = inside, inside
        self.held: list[pa.Array] = []

    def feed(self, values: pa.Array) -> tuple[int, pa.Array]:
        """Kind and texts of what the lines complete."""
        marks = pc.count_substring(values, self.quote).to_numpy(zero_copy_only=False)
        after = (np.cumsum(marks) + self.odd) % 2 == 1
        self.odd = bool(after[-1])
        ends = np.flatnonzero(~after) + 1
        if not len(ends):
            self.held.append(values)
            return WHOLE, _NOTHING
        last = int(ends[-1])
        borders = np.concatenate([[0], ends + sum(map(len, self.held))])
        # The first of a block that begins inside a value is the end of a record, all others are whole.
        wanted = borders[: 1 + self.begun] if self.fragments else borders[int(self.begun) :]
        records = _joined([*self.held, values.slice(0, last)], wanted)
        self.held, self.begun = [values.slice(last)] if last < len(values) else [], False
        return TAIL if self.fragments else WHOLE, records if self.header is None else self._below_header(records)

    def _below_header(self, records: pa.Array) -> pa.Array:
        first = next((i for i, r in enumerate(records) if r.as_py().strip()), None)
        if first is None:
            return records
        found = records[first].as_py()
        if next(csv.reader([found.rstrip("\r")], quotechar=self.quote)) != self.header:
            raise ValueError(f"a file with other columns than {self.header}: {found!r}")
        self.header = None
        return pa.concat_arrays([records.slice(0, first), records.slice(first + 1)])

    def rest(self) -> tuple[int, pa.Array]:
        if not self.fragments or not self.held:
            return WHOLE, _NOTHING
        return INNER if self.begun else HEAD, _joined(self.held, np.array([0, sum(map(len, self.held))]))


def _records(inside: set[tuple[int, int]], quote: str, names: list[str], fragments: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(state: _Block, found: tuple[int, pa.Array]) -> Iterator[pa.RecordBatch]:
            kind, records = found
            if n := len(records):
                columns = [pa.repeat(pa.scalar(state.file, pa.int64()), n), pa.repeat(pa.scalar(state.block, pa.int64()), n), pa.repeat(pa.scalar(kind, pa.int32()), n), records]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "record"])

        state = None
        for rows in batches:
            if not rows.num_rows:
                continue
            file, block = rows.column("file").to_numpy(), rows.column("block").to_numpy()
            values = rows.column("value").cast(pa.string())
            edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
                key = int(file[low]), int(block[low])
                if state is None or (state.file, state.block) != key:
                    if state is not None:
                        yield from batch(state, state.rest())
                    state = _Block(*key, key in inside, quote, names, fragments)
                yield from batch(state, state.feed(values.slice(low, high - low)))
        if state is not None:
            yield from batch(state, state.rest())

    return run


def _stitched(fragments: DataFrame) -> DataFrame:
    """Records made of the begin, any whole blocks and the end, in the order of blocks."""
    in_file = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == HEAD, 1).otherwise(0))
    numbered = fragments.withColumn("number", F.sum(F.when(F.col("kind") == HEAD, 1).otherwise(0)).over(in_file))
    parts = F.sort_array(F.collect_list(F.struct("block", "record")))
    whole = numbered.groupBy("file", "number").agg(F.min("block").alias("block"), parts.alias("parts"))
    return whole.select("file", "block", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))


def csv_records(spark: SparkSession, path: str, names: list[str], quote: str = '"') -> DataFrame:
    """(file, block, record): the text of every record, blank lines left out, line breaks inside quotes kept.

    The first record of every file must be ``names`` and is left out.

    A file whose quotation marks do not pair up cannot be divided and raises an error. The files are
    scanned three times: for the marks, the records and the fragments.
    """
    lines = _lines(spark, path)
    inside, unpaired = inside_blocks(lines, quote)
    if unpaired:
        raise UnpairedQuotes(f"{len(unpaired)} file(s) below {path} hold an odd number of quotation marks")
    whole = lines.mapInArrow(_records(inside, quote, names, fragments=False), _SCHEMA).select("file", "block", "record")
    if inside:
        whole = whole.unionByName(_stitched(lines.mapInArrow(_records(inside, quote, names, fragments=True), _SCHEMA)))
    # The carriage return of a record's own end is no part of its last value.
    text = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return whole.withColumn("record", text).where(F.trim("record") != "")


def read_split_csv(spark: SparkSession, path: str, types: dict[str, T.DataType], options: dict[str, str]) -> DataFrame:
    """Header CSV with quoted line breaks, typed by column name (strings where ``types`` has none).

    All files must have the same header line. The rows are those of Spark's multi-line reader with
    the same ``options``, a value that does not fit its type fails.
    """
    names = spark.read.options(header=True, **options).csv(path).columns
    columns = ", ".join(f"`{c.replace('`', '``')}` {types.get(c, T.StringType()).simpleString()}" for c in names)
    parsed = F.from_csv("record", F.lit(columns), {**options, "multiLine": "true", "mode": "FAILFAST"})
    return csv_records(spark, path, names, options.get("quote", '"')).select(parsed.alias("r")).select("r.*")
