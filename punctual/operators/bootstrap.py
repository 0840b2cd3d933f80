"""Intervals of rates and differences by the Poisson bootstrap, in one pass and without randomness.

In every replicate a row counts as often as a Poisson variable of mean 1 says, which is read off a
hash of the row's key and the replicate's number: the same on every partitioning, on every machine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200
#: Replicates read off one 128-bit hash.
_PER_HASH = 4
#: A hash of 32 bits below the i-th bound counts i times.
BOUNDS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))) for i in range(12)]


def _weight(part: Column) -> Column:
    """How often a row counts, by four bytes of its hash, which compare as their numbers do; missing for a row not drawn.

    Small weights are found first: one row in three is done after one comparison, two in three after two.
    """
    bounds = [F.lit(bound.to_bytes(4, "big")) for bound in BOUNDS]
    weight = F.when(part < bounds[0], F.lit(None).cast("int"))
    for i, bound in enumerate(bounds[1:], 1):
        weight = weight.when(part < bound, i)
    return weight.otherwise(len(BOUNDS))


def replicate_sums(frame: DataFrame, key: str, measures: dict[str, Column], by: tuple[str, ...] = (), replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(replicate, *by, drawn, measures): rows drawn and weighted sums of integer measures in every replicate.

    The narrow rows are dealt over all cores first, because hashing costs far more than reading a small
    stored table. They are repeated once per hash, not per replicate, inside a task, which adds them up
    at once: what is shuffled then is one row per hash, group and task. Digests are cut and compared as
    bytes, because parts of a string are found character by character. Replicates that drew no row of
    a group are left out.
    """
    hashes = -(-replicates // _PER_HASH)
    wide = frame.select(*by, F.col(key).alias("_key"), *[m.cast("long").alias(n) for n, m in measures.items()])
    dealt = wide.repartition(frame.sparkSession.sparkContext.defaultParallelism)
    # What is hashed is "key:hash:seed", and "hash:seed" where the key is missing.
    named = dealt.withColumn("_key", F.coalesce(F.concat(F.col("_key").cast("string"), F.lit(":")), F.lit("")))
    rests = F.array(*[F.struct(F.lit(i).alias("hash"), F.lit(f"{i}:{seed}").alias("text")) for i in range(hashes)])
    numbered = named.withColumn("_rest", F.explode(rests))
    # Digest, its parts and the weights are columns of their own, so that each is computed once a row.
    digest = F.unhex(F.md5(F.concat("_key", "_rest.text")))
    hashed = numbered.select(*by, *measures, F.col("_rest.hash").alias("_hash"), digest.alias("_digest"))
    places = range(_PER_HASH)
    parts = hashed.select(*by, *measures, "_hash", *[F.substring("_digest", 1 + 4 * i, 4).alias(f"_p{i}") for i in places])
    weighed = parts.select(*by, *measures, "_hash", *[_weight(F.col(f"_p{i}")).alias(f"_w{i}") for i in places])
    sums = weighed.groupBy("_hash", *by).agg(
        *[F.sum(f"_w{i}").alias(f"_drawn{i}") for i in places],
        *[F.sum(F.col(m) * F.col(f"_w{i}")).alias(f"_{m}{i}") for i in places for m in measures],
    )
    of_one = [F.struct((F.col("_hash") * _PER_HASH + i).alias("replicate"), F.col(f"_drawn{i}").alias("drawn"), *[F.col(f"_{m}{i}").alias(m) for m in measures]) for i in places]
    each = sums.select(*by, F.explode(F.array(*of_one)).alias("_one")).select("_one.replicate", *by, "_one.drawn", *[f"_one.{m}" for m in measures])
    return each.where(F.col("drawn").isNotNull() & (F.col("replicate") < replicates))


def _with_interval(whole: DataFrame, statistic: DataFrame, outside: float) -> DataFrame:
    """The one row of ``whole`` with (low, high): the replicates' values with ``outside`` / 2 of them beyond on either side.

    The values are one short array; the bounds are a scalar, so no rows are joined without a key.
    """
    values = statistic.where("value is not null").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = lambda share: F.get("v", F.rint((F.size("v") - 1) * share).cast("int"))
    bounds = values.select(F.struct(at(outside / 2).alias("low"), at(1 - outside / 2).alias("high")).alias("bounds"))
    return whole.select("*", bounds.scalar().alias("_bounds")).select(*whole.columns, "_bounds.low", "_bounds.high")


def mean_interval(frame: DataFrame, key: str, value: Column, outside: float = 0.05, **options) -> DataFrame:
    """One row (n, mean, low, high): the mean of an integer or boolean value; missing values do not count.

    Without a value mean and bounds are missing. ``key`` names the rows: rows of one key are drawn together.
    """
    present = frame.select(F.col(key).alias("_id"), value.cast("long").alias("_v")).where("_v is not null")
    whole = present.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    sums = replicate_sums(present, "_id", {"total": F.col("_v")}, **options)
    return _with_interval(whole, sums.select((F.col("total") / F.col("drawn")).alias("value")), outside)


def score_difference(features: DataFrame, outside: float = 0.05, **options) -> DataFrame:
    """One row (n, difference, low, high): mean score of on-time less late reviews, missing scores left out."""
    scored = features.where("review_score is not null").select("review_id", "is_late", "review_score")
    on_time, late = (F.when(F.col("is_late") == side, 1).otherwise(0) for side in (False, True))
    measures = {"n0": on_time, "s0": on_time * F.col("review_score"), "n1": late, "s1": late * F.col("review_score")}
    difference = F.try_divide("s0", "n0") - F.try_divide("s1", "n1")
    whole = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(name) for name, m in measures.items()])
    # Two sums a side, which come in rows of their own, instead of four of which two are zero.
    sides = replicate_sums(scored, "review_id", {"score": F.col("review_score")}, by=("is_late",), **options)
    of_side = [F.sum(F.when(F.col("is_late") == late, F.col(c))).alias(f"{c[0]}{int(late)}") for late in (False, True) for c in ("n", "score")]
    sums = sides.withColumnRenamed("drawn", "n").groupBy("replicate").agg(*of_side)
    return _with_interval(whole.select("n", difference.alias("difference")), sums.select(difference.alias("value")), outside)
