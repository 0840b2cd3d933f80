"""Mixing sources to target weights by a low-discrepancy slot schedule.

DataFrame functions only. Sizes are words; the only pass over the texts counts them, all else works
on one narrow row per document, block piece or slot.

1. Targets: each source's share by weight, never above ``MAX_REPEATS`` times its size (water filling).
2. Stream: a source's documents in hash order, one after the other, repeated from the start until
   the target is reached; the stream is cut into blocks of ``BLOCK`` words.
3. Schedule: slot ``i`` gets the golden-ratio point ``frac((i + 1/2) * phi)``, mapped through the
   cumulative slot shares to a source. The slots of a source are ranked; the k-th slot takes the
   source's k-th block. Slots that a source has too many (the discrepancy, of logarithmic size) are
   dropped, missing ones are appended at the end.

A source may hold any part of the rows: running sums and ranks are taken in ``BUCKETS`` hash buckets
(ranges of slots) per source and shifted by the sums of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import row_mark
from .storage import stored

WORD = r"[^\x20\x09-\x0D]+"
#: By rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a block.
BLOCK = 4_096
#: Parts of a source whose running sums are taken on their own; raise it with the rows of the largest source.
BUCKETS = 1_024
#: Parts of [0, 1) that turn the search for a point's source into an equality join.
BINS = 1_024
SEED = "mix-1"
#: The fractional part of the golden ratio in units of 2^-64, and from it those of phi and of 2^20 phi.
_PHI_64 = 0x9E3779B97F4A7C15
_PHI = _PHI_64 / 2**64
_PHI_HIGH = (_PHI_64 << 20) % 2**64 / 2**64


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of an md5: the place of a document in its source's stream."""
    text = F.concat(F.lit(SEED + "|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, mark: Column) -> DataFrame:
    """(doc_id, _mark, _source, _size, _key, _bucket) of every row; ``_source`` is never null."""
    key = shuffle_key(F.col("doc_id"))
    return docs.select(
        "doc_id",
        mark.alias("_mark"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_source"),
        word_count(F.col("text")).alias("_size"),
        key.alias("_key"),
        F.floor(key / F.lit((1 << 60) // BUCKETS)).cast("long").alias("_bucket"),
    )


def source_targets(buckets: DataFrame) -> DataFrame:
    """One row per source: size, weight, target and quota (the target in whole words).

    ``buckets`` has (_source, _size). Sources below their cap share what the capped ones leave; with
    sources in order of cap per weight the capped ones come first, so two running sums settle it.
    """
    sizes = buckets.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    # "n" marks the null source and sorts before every "s...": null goes last.
    by_name = Window.orderBy(F.col("_source") == "n", "_source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("rank") % len(WEIGHTS) + 1).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", MAX_REPEATS * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("open") <= F.col("weight") * F.col("rest"))
    )
    shared = (
        level.withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("open", F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("rest").cast("double") / F.col("open").cast("double")
    )
    return (
        shared.withColumn("target", target)
        .withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("cap")).cast("long"))
        .select("_source", "source_size", "weight", "target", "quota")
    )


def _placed(keyed: DataFrame, sums: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the source's figures and ``_begin``: the words of the source's stream before the document."""
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size").join(targets, "_source")
    inside = (
        Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "_size", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    )
    return keyed.join(offsets, ["_source", "_bucket"]).withColumn(
        "_begin", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    )


def _rounds(placed: DataFrame) -> DataFrame:
    """One row per document and pass of the stream that takes words of it: ``_round``, ``_from``, ``_words``."""
    last = F.floor((F.col("quota") - F.col("_begin") - 1) / F.greatest(F.col("source_size"), F.lit(1)))
    return (
        placed.where("_size > 0 and _begin < quota")
        .withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("_from", F.col("_round") * F.col("source_size") + F.col("_begin"))
        .withColumn("_words", F.least(F.col("_size"), F.col("quota") - F.col("_from")))
    )


def slots(targets: DataFrame) -> DataFrame:
    """(_source, block, position): the slot that takes each block of each source's stream."""
    spark = targets.sparkSession
    needs = targets.where("quota > 0").select("_source", F.ceil(F.col("quota") / F.lit(BLOCK)).cast("long").alias("n"))
    total = needs.agg(F.sum("n")).first()[0] or 0
    upto = Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, 0)
    shares = (
        needs.withColumn("high", F.sum("n").over(upto))
        .withColumn("low", (F.col("high") - F.col("n")) / F.lit(float(max(total, 1))))
        .withColumn("high", F.col("high") / F.lit(float(max(total, 1))))
        .withColumn(
            "bin",
            F.explode(
                F.sequence(
                    F.floor(F.col("low") * BINS).cast("long"),
                    F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)).cast("long"),
                )
            ),
        )
    )
    i = F.col("id")
    # In two parts, so that products stay small and the fraction keeps its digits for any slot number.
    point = (F.floor(i / F.lit(1 << 20)) * _PHI_HIGH + (i % (1 << 20)) * _PHI + 0.5 * _PHI) % 1.0
    points = spark.range(total).select(
        i.alias("position"), point.alias("u"), F.floor(i * F.lit(BUCKETS) / F.lit(max(total, 1))).cast("long").alias("part")
    )
    hit = points.withColumn("bin", F.floor(F.col("u") * BINS).cast("long")).join(shares.select("_source", "low", "high", "bin"), "bin")
    hit = hit.where("u >= low and u < high").select("_source", "part", "position")
    earlier = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = hit.groupBy("_source", "part").agg(F.count("*").alias("n"))
    offsets = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("_source", "part").orderBy("position")
    ranked = (
        hit.join(offsets, ["_source", "part"])
        .withColumn("block", F.col("before") + F.row_number().over(inside) - 1)
        .join(needs, "_source")
        .where("block < n")
        .select("_source", "block", "position")
    )
    got = counted.groupBy("_source").agg(F.sum("n").alias("got"))
    missing = (
        needs.join(got, "_source", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < n")
        .withColumn("after", F.sum(F.col("n") - F.col("got")).over(upto) - (F.col("n") - F.col("got")))
        .select("_source", "got", "after", F.explode(F.sequence("got", F.col("n") - 1)).alias("block"))
        .select("_source", "block", (F.lit(total) + F.col("after") + F.col("block") - F.col("got")).alias("position"))
    )
    return ranked.union(missing)


def _streams(docs: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source's stream, sources with their targets), narrow and stored."""
    narrow = stored(_keyed(docs, mark), "sizes")
    sums = stored(narrow.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_size")), "sums")
    targets = stored(source_targets(sums), "targets")
    return stored(_placed(narrow, sums, targets), "placed"), targets


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in the stream, schedule of block pieces), both narrow.

    The schedule has one row per piece of a document in a slot: position of the slot, source, block,
    the document's place ``_begin`` in the source's stream, the pass ``_round`` and its words.
    """
    placed, targets = _streams(docs, F.lit(0).cast("long"))
    first = F.floor(F.col("_from") / F.lit(BLOCK)).cast("long")
    last = F.floor((F.col("_from") + F.col("_words") - 1) / F.lit(BLOCK)).cast("long")
    pieces = (
        _rounds(placed)
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("low", F.greatest(F.col("_from"), F.col("block") * BLOCK))
        .withColumn("high", F.least(F.col("_from") + F.col("_words"), (F.col("block") + 1) * BLOCK))
        .select(
            "_source", "block", "doc_id", "_begin", "_round",
            (F.col("low") - F.col("_from")).alias("first_word"), (F.col("high") - F.col("low")).alias("words"),
        )
    )
    return placed, pieces.join(slots(targets), ["_source", "block"])


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, slot_words) per row of ``docs`` (doc_id, text, source, others).

    ``taken`` counts the words the schedule takes of the row, repeats included: at most
    ``MAX_REPEATS`` times its size. ``first_slot`` is the slot of its first word in the first pass of
    the stream and ``slot_words`` the sum of slot number times words over all its pieces (null and 0
    for a row that is not taken). A null or empty text has size 0 and is never taken. The null
    source is a source. Repeated rows are separate documents next to each other in the stream, so
    equal rows can get different counts. An empty table gives an empty table; the order within a
    stream is fixed by the hash of doc_id, so reruns agree.
    """
    placed, schedule = plan(docs)
    begins = (F.col("_round") == 0) & (F.col("first_word") == 0)
    taken = schedule.groupBy("_source", "_begin").agg(
        F.sum("words").alias("taken"),
        F.min(F.when(begins, F.col("position"))).alias("first_slot"),
        F.sum(F.col("position") * F.col("words")).alias("slot_words"),
    )
    # Of the rows at one place only one has words; the others are taken 0 times.
    return placed.join(taken, ["_source", "_begin"], "left").select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.when(F.col("_size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("_size") > 0, F.col("first_slot")).alias("first_slot"),
        F.when(F.col("_size") > 0, F.coalesce("slot_words", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("slot_words"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the schedule takes them: one row per pass of the stream that takes the row.

    Rows come in the order of the slots: a row stands whole at the slot of its first word, and each
    of the session's shuffle partitions holds an equal range of slots, sorted. The columns are those
    of ``docs``. Text and ``n_chars`` (where it exists) change only in the one row per source at
    which the target is reached: its words beyond are cut off, the kept ones are joined by single
    spaces. Rows without words are not taken. The null source is a source. Equal rows are separate
    rows of the stream and come as often as it takes them; what comes is the same for any
    partitioning. An empty table gives an empty table.

    Places, passes and slots are found on narrow rows. The texts are shuffled twice: to meet their
    places, by doc_id and a hash of the row, and into the ranges of slots.
    """
    mark = row_mark(docs)
    placed, targets = _streams(docs, mark)
    total = targets.agg(F.sum(F.ceil(F.col("quota") / F.lit(BLOCK)))).first()[0] or 0
    numbered = docs.select(F.struct("*").alias("_row"), "doc_id", mark.alias("_mark"))
    one_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")
    takes = (
        _rounds(placed)
        .withColumn("block", F.floor(F.col("_from") / F.lit(BLOCK)).cast("long"))
        .join(slots(targets), ["_source", "block"])
        .select(one_id, "_mark", "position", "_round", "_begin", "_size", "_words")
    )
    rows = numbered.select(one_id, "_mark", "_row").dropDuplicates(["_id", "_mark"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("position") * parts / F.lit(max(int(total), 1))), F.lit(parts - 1)).cast("int")
    ordered = takes.join(rows, ["_id", "_mark"]).repartitionById(parts, part).sortWithinPartitions("position", "_round", "_begin")
    cut = F.col("_words") < F.col("_size")
    text = F.col("_row.text")
    kept = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")), " ")
    changed = {"text": kept, "n_chars": F.length(kept)}
    return ordered.select(
        *[
            F.when(cut, changed[c]).otherwise(F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType).alias(c)
            if c in changed
            else F.col(f"_row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
