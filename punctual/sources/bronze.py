"""The six source tables, bound to one prefix, as DataFrames and views."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.sources.split_csv import UnpairedQuotes, read_split_csv

# The source tables outside the scope of the analysis.
OUT_OF_SCOPE = ("sellers", "products", "product_category_name_translation")

_MONEY = T.DecimalType(12, 2)
_NTZ = T.TimestampNTZType()

# Columns that are not strings. Ids and zip prefixes stay strings ("01037" keeps its zero).
COLUMN_TYPES = {
    "order_purchase_timestamp": _NTZ,
    "order_approved_at": _NTZ,
    "order_delivered_carrier_date": _NTZ,
    "order_delivered_customer_date": _NTZ,
    "order_estimated_delivery_date": _NTZ,
    "review_score": T.IntegerType(),
    "review_creation_date": _NTZ,
    "review_answer_timestamp": _NTZ,
    "order_item_id": T.IntegerType(),
    "shipping_limit_date": _NTZ,
    "price": _MONEY,
    "freight_value": _MONEY,
    "payment_sequential": T.IntegerType(),
    "payment_installments": T.IntegerType(),
    "payment_value": _MONEY,
    "geolocation_lat": T.DoubleType(),
    "geolocation_lng": T.DoubleType(),
}


@dataclass(frozen=True)
class Bronze:
    """The in-scope source tables."""

    orders: DataFrame
    order_reviews: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    customers: DataFrame
    geolocation: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def create_views(self, prefix: str = "") -> dict[str, str]:
        """Register every table as a lazy temp view; returns logical name -> view name."""
        names = {name: f"{prefix}{name}" for name in self.tables()}
        for name, frame in self.tables().items():
            frame.createOrReplaceTempView(names[name])
        return names


TABLES = tuple(f.name for f in fields(Bronze))


#: The tables with free text, whose quoted values may hold line breaks.
MULTI_LINE = ("order_reviews",)


_CSV = {"quote": '"', "escape": '"', "encoding": "UTF-8", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header CSV, typed by column name; a value that does not fit its type fails.

    Only the header line is looked at to learn the columns; unknown columns are kept as strings. With
    ``multi_line`` a quoted text may hold line breaks; large files are divided all the same
    (``split_csv``), for which their quotation marks are counted here. Where these do not pair up, the
    files are left to Spark's own multi-line reader, one task per file.
    """
    if multi_line:
        try:
            return read_split_csv(spark, path, COLUMN_TYPES, _CSV)
        except UnpairedQuotes:
            pass
    reader = spark.read.options(header=True, multiLine=multi_line, **_CSV)
    schema = T.StructType(
        [T.StructField(c, COLUMN_TYPES.get(c, T.StringType())) for c in reader.csv(path).columns]
    )
    return reader.schema(schema).options(enforceSchema=False, mode="FAILFAST").csv(path)


@dataclass(frozen=True)
class Sources:
    """Where the source tables live: one prefix relocates all of them.

    ``fmt`` is ``csv``, ``parquet`` or ``table``; ``pattern`` turns a logical table name into a
    file, folder or catalog name below ``prefix``.
    """

    prefix: str = ""
    fmt: str = "csv"
    pattern: str = "{table}"

    def location(self, table: str) -> str:
        name = self.pattern.format(table=table)
        if not self.prefix:
            return name
        separator = "." if self.fmt == "table" else "/"
        return f"{self.prefix.rstrip(separator)}{separator}{name}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if table not in TABLES:
            raise KeyError(f"{table!r} is not one of the source tables {TABLES}")
        where = self.location(table)
        if self.fmt == "csv":
            return read_csv(spark, where, table in MULTI_LINE)
        if self.fmt == "parquet":
            return spark.read.parquet(where)
        if self.fmt == "table":
            return spark.table(where)
        raise ValueError(f"unknown source format {self.fmt!r}")

    def bronze(self, spark: SparkSession) -> Bronze:
        return Bronze(**{table: self.read(spark, table) for table in TABLES})


def register_frame(spark: SparkSession, frame, name: str) -> DataFrame:
    """Expose a DataFrame, or a small pandas frame, to SQL under ``name``."""
    if not isinstance(frame, DataFrame):
        frame = spark.createDataFrame(frame)
    frame.createOrReplaceTempView(name)
    return frame


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (table_name, n_rows) per table."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, frame in tables.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result
