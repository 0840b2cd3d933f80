"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken 2003), in DataFrame functions only.

The grams of a text are its runs of ``GRAM`` words, each with a 32-bit hash. Of every ``WINDOW``
consecutive grams the one with the least hash is chosen, the rightmost of equal ones, and kept with
its position (the number of the gram's first word). Guarantee: a run of ``GRAM + WINDOW - 1`` words
that two texts share gives them a common fingerprint; no run below ``GRAM`` words ever does. A text
of fewer words than a gram is one gram; a text of fewer grams than a window is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

GRAM = 5
WINDOW = 6
_LOW31 = (1 << 31) - 1
_LOW32 = (1 << 32) - 1
_GAP = r"[\x20\x09-\x0D]+"


def winnowed(text: Column) -> Column:
    """The chosen grams in text order, each as one long: hash in the upper 32 bits, 2^31 - 1 - position below.

    The least long of a window is its least hash, and of equal hashes the rightmost.
    """

    def keys(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - (GRAM - 1), F.lit(1)))
        return F.transform(
            starts,
            lambda i: F.shiftleft(F.xxhash64(F.slice(hashes, i, GRAM)).bitwiseAND(F.lit(_LOW32)), 31).bitwiseOR(
                F.lit(_LOW31) - (i - 1).cast("long")
            ),
        )

    def chosen(grams: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(grams) - (WINDOW - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, WINDOW))))

    # Each step is bound once as the element of a one-row array, so that it is evaluated once.
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")
    steps = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), keys)
    result = F.element_at(F.transform(steps, chosen), 1)
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, F.expr("cast(array() as array<bigint>)")).otherwise(result)


def hashes(picks: Column) -> Column:
    """The distinct 32-bit hashes of the chosen grams, as signed integers."""
    return F.array_distinct(F.transform(picks, lambda p: (F.shiftrightunsigned(p, 31) - F.lit(1 << 31)).cast("int")))


def as_text(picks: Column) -> Column:
    """``hash@position`` of every chosen gram, hash in hexadecimal, in text order."""
    return F.array_join(
        F.transform(
            picks,
            lambda p: F.concat(
                F.lower(F.hex(F.shiftrightunsigned(p, 31))), F.lit("@"), (F.lit(_LOW31) - p.bitwiseAND(F.lit(_LOW31))).cast("string")
            ),
        ),
        " ",
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, text, picks): the chosen grams of every whole text."""
    return docs.select("doc_id", "text", winnowed(F.col("text")).alias("picks"))


def neighbours(narrow: DataFrame) -> DataFrame:
    """Previous document of each (id, mark) in descending order of doc_id: columns prev_id, prev_mark, prev_chars.

    ``narrow`` has distinct (id, mark, doc_id, chars); the order is circular. Rows are sorted by
    ranges; only the first row of each range meets the others, in a table of one row per range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").desc()]
    ranged = stored(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    row = F.struct("id", "mark", "chars")
    within = ranged.withColumn("prev", F.lag(row).over(inside)).withColumn("next", F.lead(row).over(inside))
    within = stored(within, "within")
    lasts = within.where("next is null").select("part", row.alias("last"))
    around = Window.orderBy("part")
    everything = Window.partitionBy()
    edges = lasts.select(
        "part", F.coalesce(F.lag("last").over(around), F.max_by("last", "part").over(everything)).alias("edge")
    )
    met = within.where("prev is null").join(edges, "part").withColumn("prev", F.col("edge")).drop("edge")
    return within.where("prev is not null").unionByName(met).select(
        "id", "mark", F.col("prev.id").alias("prev_id"), F.col("prev.mark").alias("prev_mark"), F.col("prev.chars").alias("prev_chars")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last third of the code points (rounded down) replaced by as many first
    code points of the next document (or all it has) in descending order of doc_id; after the last
    comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, one row per row of ``docs``.

    Null text is empty; a text without words has the empty fingerprint, and two empty fingerprints
    have likeness 1. Rows with equal doc_id and equal text are one document and get equal results;
    documents that share a doc_id follow each other by a hash of their text. Null doc_ids come last.
    A single document is its own next one. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), text.alias("text")).withColumn(
        "mark", F.xxhash64("text")
    )
    id_number = F.nullif(F.col("id"), F.lit("")).cast("long")
    narrow = base.select("id", "mark", id_number.alias("doc_id"), F.length("text").alias("chars")).distinct()
    # What the previous document needs of each: the head that may replace its tail, and the hashes.
    # Both joins read the same exchange of the texts; fingerprints are taken after it, being larger.
    heads = base.join(neighbours(narrow), ["id", "mark"]).select(
        F.col("prev_id").alias("id"),
        F.col("prev_mark").alias("mark"),
        F.expr("substring(text, 1, cast(floor(prev_chars / 3) as int))").alias("head"),
        hashes(winnowed(F.col("text"))).alias("next_hashes"),
    )
    one = Window.partitionBy("id", "mark").orderBy("mark")
    heads = heads.withColumn("copy", F.row_number().over(one)).where("copy = 1").drop("copy")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 3) as int))"), F.col("head"))
    met = base.join(heads, ["id", "mark"]).withColumn("edited", edited).select(
        id_number.alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        winnowed(F.col("text")).alias("picks"),
        winnowed(F.col("edited")).alias("edited_picks"),
        "next_hashes",
    )
    own = hashes(F.col("picks"))
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("picks")).alias("fingerprint"),
        as_text(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_picks"))).alias("near_edited"),
        likeness(own, F.col("next_hashes")).alias("near_next"),
    )
