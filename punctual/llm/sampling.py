"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _agreed(labels: DataFrame, label: str, eligible: Column | None) -> DataFrame:
    """(doc_id, label): ids with one label; contradicting labels, null ids and null labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label is not null"
    )
    known = known if eligible is None else known.where(eligible)
    agreed = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    return agreed.select("doc_id", "label")


def _with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, eligible: Column | None = None) -> DataFrame:
    """(doc_id, text, label): every document with a label, by the rules of ``labelled_sample``."""
    return _with_texts(docs, _agreed(labels, label, eligible))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, eligible: Column | None = None) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` documents with a label, in the order of a hash of their id.

    Only ids and labels are read to choose; the chosen ids, at most ``rows`` of them, are broadcast
    to fetch the texts. Ids with contradicting labels, null ids and null labels are left out; of
    repeated documents one text is taken.
    """
    chosen = _agreed(labels, label, eligible).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return _with_texts(docs, F.broadcast(chosen))


def row_mark(frame: DataFrame) -> Column:
    """A 64-bit hash of the row; maps, which have no hash, are left out."""
    values = [F.col(f"`{f.name}`") for f in frame.schema.fields if "map<" not in f.dataType.simpleString()]
    # Nulls leave a hash unchanged, so it takes which of the values are null as well.
    return F.xxhash64(F.concat(*[F.when(v.isNull(), "n").otherwise("v") for v in values]), *values)
