"""Tables that an operator reads more than once, and the size of what Python workers get."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: what a Python worker holds at a time grows with these alone
#: (and with the longest single text).
BATCH_ROWS = 2_000
BATCH_BYTES = 16 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set to a new temporary folder only in a local test session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="punctual-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/punctual-llm/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back: lost executors repeat nothing before it.

    An empty table keeps its schema.
    """
    spark = frame.sparkSession
    path = new_folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, unless their path already has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    inherited = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or any(os.path.realpath(p) == os.path.realpath(root) for p in inherited if p):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="punctual-"), "punctual.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for folder, _, names in os.walk(os.path.join(root, "punctual")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """For the Python stages of this session: small Arrow batches whatever the texts' length, and this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _ship_package(spark)
