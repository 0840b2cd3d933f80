"""Tables stored in hash partitions of a key, of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctual.sources.cache import COMPRESSION, ResultCache

#: Hash partitions of a table; choose them so that one partition is some hundred megabytes.
PARTITIONS = 64


class HashPartitions:
    """One table below ``root``/``name`` with all rows of a key in one hash partition.

    Every write is a version that holds the partitions it wrote; a small table, itself versioned by a
    manifest, says which version of each partition counts (none: the partition is empty). It is
    swapped when the files are complete, so a write that breaks off leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, partitions: int = PARTITIONS):
        self.spark, self.name, self.key, self.partitions = spark, name, key, partitions
        self.cache = ResultCache(spark, root)
        self.schema = None

    def bucket(self, key: Column | None = None) -> Column:
        """The partition of a key; a missing key has one, too."""
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.partitions)).cast("int")

    def _current(self) -> dict[int, int]:
        """Version of every partition that has rows: at most ``partitions`` numbers."""
        return {r.bucket: r.version for r in self.cache.load(f"{self.name}/current").collect()}

    def _dealt(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("_bucket", self.bucket()).repartition("_bucket")

    def _write(self, dealt: DataFrame, touched: list[int] | None) -> None:
        """Store ``dealt`` as what the ``touched`` partitions hold from now on (``None``: all of them)."""
        self.schema = dealt.drop("_bucket").schema
        known = {} if touched is None else self._current()
        version = max(self.cache._folders(self.name, "version"), default=0) + 1
        path = self.cache.path(f"{self.name}/version={version}")
        dealt.write.option("compression", COMPRESSION).partitionBy("_bucket").parquet(path)
        # Which partitions the version holds is read off its folders.
        written = {b for b in self.cache._folders(f"{self.name}/version={version}", "_bucket")}
        kept = {b: v for b, v in known.items() if b not in set(touched or ())}
        rows = sorted({**kept, **{b: version for b in written}}.items())
        self.cache.save(f"{self.name}/current", self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1))

    def create(self, frame: DataFrame) -> None:
        self._write(self._dealt(frame), None)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or only the partitions ``buckets``; no other file is opened."""
        current = self._current()
        wanted = sorted(current if buckets is None else set(buckets) & set(current))
        paths = [self.cache.path(f"{self.name}/version={current[b]}/_bucket={b}") for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """The partitions of ``keys``: at most ``partitions`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def near(self, keys: DataFrame) -> DataFrame:
        """All rows of the partitions in which ``keys`` (one column, the key) lie."""
        return self.read(self.touched(keys))

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (one column, the key), read from their partitions alone."""
        same = F.col(f"t.{self.key}").eqNullSafe(F.col(f"k.{self.key}"))
        return self.read(self.touched(keys)).alias("t").join(keys.distinct().alias("k"), same, "left_semi")

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Exchange everything under ``keys`` for ``rows``; returns the partitions that were rewritten.

        ``keys`` is read several times: pass a stored table. ``rows`` must have the table's columns and
        no other keys.
        """
        touched = self.touched(keys)
        if touched:
            stored = self.read(touched)
            # Rows and keys meet where the rows are dealt to their partitions, so no row moves twice.
            marked = stored.withColumn("_gone", F.lit(False)).unionByName(keys.distinct().withColumn("_gone", F.lit(True)), allowMissingColumns=True)
            of_key = Window.partitionBy("_bucket", self.key)
            others = self._dealt(marked).withColumn("_any", F.max("_gone").over(of_key)).where("not _any").drop("_gone", "_any")
            self._write(others.unionByName(self._dealt(rows.select(*stored.columns))), touched)
        return touched
