"""Parquet materialisation, and named results that know what they were made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Codec of stored tables: review texts take about two thirds of what Spark's default leaves of them.
COMPRESSION = "zstd"


def materialize(frame: DataFrame, path: str) -> DataFrame:
    """Write ``frame`` as Parquet and read it back: lineage ends at the files.

    An earlier table at ``path`` is replaced; frames that still read it must be finished first.
    The re-read frame has exact size statistics, so later joins broadcast it only when it fits
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    frame.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    return frame.sparkSession.read.parquet(path)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _hashable(name: str, kind: T.DataType) -> list[Column]:
    """What of a column goes into a hash: its value, and whether it is missing, which a hash alone does not tell."""
    column = F.col(f"`{name.replace('`', '``')}`")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        # Missing parts are written out; entries of a map have no order, so they are sorted.
        entries = F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) and not _holds_map(kind.valueType) else column
        return [F.to_json(F.struct(entries.alias("v")), {"ignoreNullFields": "false"}), column.isNull()]
    return [column, column.isNull()]


def table_digest(frame: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever the order of the rows.

    Two 64-bit hashes of every row and their products are added up beside the number of rows, in one
    aggregate that is combined where the rows are read. A changed, added, dropped or repeated row
    changes it, and so do other names or types.
    """
    parts = [c for f in frame.schema.fields for c in _hashable(f.name, f.dataType)]
    hashed = frame.select(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = F.xxhash64("a", "b").cast("decimal(20,0)")
    sums = hashed.agg(F.count(F.lit(1)).alias("n"), F.sum(wide("a")).alias("a"), F.sum(wide("b")).alias("b"), F.sum(both).alias("c")).first()
    told = "|".join([frame.schema.simpleString(), *[str(v) for v in sums]])
    return hashlib.sha256(told.encode()).hexdigest()


def inputs_digest(inputs: Mapping[str, DataFrame]) -> str:
    """A digest of named tables."""
    told = "\n".join(f"{name}={table_digest(frame)}" for name, frame in sorted(inputs.items()))
    return hashlib.sha256(told.encode()).hexdigest()


_MANIFEST = "version long, inputs string"


class ResultCache:
    """Results that are expensive to build, stored as Parquet below one shared folder.

    A result is the version that its newest complete manifest names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _complete(self, name: str) -> bool:
        """True for a complete write: the commit marker is there."""
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def _manifest(self, name: str) -> Row | None:
        """The newest complete manifest of ``name``: (version, inputs)."""
        for number in reversed(self._folders(name, "manifest")):
            if self._complete(f"{name}/manifest={number}"):
                return self.spark.read.schema(_MANIFEST).parquet(self.path(f"{name}/manifest={number}")).first()
        return None

    def exists(self, name: str) -> bool:
        return self._manifest(name) is not None

    def _folders(self, name: str, prefix: str) -> list[int]:
        """Numbers of the folders ``<prefix>=<number>`` below ``name``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [status.getPath().getName() for status in system.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))

    def generation(self, name: str, new: bool = False) -> str:
        """The newest generation of ``name``, or with ``new`` (or without any) the next one."""
        found = self._folders(name, "generation")
        number = (found[-1] if found else 0) + (new or not found)
        return f"{name}/generation={number}"

    def append(self, name: str, frame: DataFrame) -> None:
        """Store ``frame`` as one more run of ``name``. Earlier runs are never touched."""
        runs = self._folders(name, "run")
        frame.write.option("compression", COMPRESSION).parquet(self.path(f"{name}/run={(runs[-1] if runs else 0) + 1}"))

    def runs(self, name: str, schema: str) -> DataFrame:
        """All complete runs of ``name`` as one table; a run whose write broke off is left out."""
        complete = [f"{name}/run={n}" for n in self._folders(name, "run")]
        paths = [self.path(run) for run in complete if self._complete(run)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def save(self, name: str, frame: DataFrame, inputs: str | None = None) -> DataFrame:
        """Store ``frame`` as the next version of ``name`` and return it as read from its files.

        The version's files are written beside the earlier ones; then a manifest that names it is
        written, and only from then on is it what ``load`` finds. A write that breaks off in between
        leaves the earlier result as it was. ``frame`` may read that earlier result. Two versions are
        kept for readers that still hold the older one.
        """
        # A broken-off attempt's folder is never used again.
        version = max([*self._folders(name, "version"), *self._folders(name, "manifest"), 0]) + 1
        path = self.path(f"{name}/version={version}")
        frame.write.option("compression", COMPRESSION).parquet(path)
        manifest = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(inputs).cast("string").alias("inputs"))
        manifest.coalesce(1).write.parquet(self.path(f"{name}/manifest={version}"))
        self._drop_before(name, version)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _drop_before(self, name: str, version: int) -> None:
        """Delete what is older than the version before ``version``."""
        complete = [n for n in self._folders(name, "manifest") if n < version and self._complete(f"{name}/manifest={n}")]
        oldest = complete[-1] if complete else version
        for prefix in ("manifest", "version"):
            for number in self._folders(name, prefix):
                if number < oldest:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(f"{name}/{prefix}={number}"))
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def load(self, name: str) -> DataFrame:
        manifest = self._manifest(name)
        if manifest is None:
            raise FileNotFoundError(f"no complete result at {self.path(name)}")
        return self.spark.read.parquet(self.path(f"{name}/version={manifest.version}"))

    def load_or_build(
        self,
        name: str,
        build: Callable[[], DataFrame],
        regenerate: bool = False,
        inputs: Mapping[str, DataFrame] | None = None,
    ) -> DataFrame:
        """Load ``name``; build and store it first when it is missing, incomplete, forced or outdated.

        With ``inputs``, the tables it is made from, it is outdated once any of them holds other rows
        than those it was last built from; their order does not matter.
        """
        digest = None if inputs is None else inputs_digest(inputs)
        manifest = None if regenerate else self._manifest(name)
        if manifest is None or digest is not None and manifest.inputs != digest:
            return self.save(name, build(), digest)
        return self.load(name)
