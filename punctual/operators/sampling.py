"""Reproducible sampling and batching by hashed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of the hash that name a bucket: 16^4 buckets. Raise it with the population.
HASH_DIGITS = 4


def seeded_hash(key: str, seed: int) -> Column:
    """The sampling order: md5 of key and seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_ranked(
    frame: DataFrame, key: str, n: int | None, seed: int, hash_digits: int = HASH_DIGITS
) -> DataFrame:
    """``min(n, all)`` rows with ``rank``, their exact 1-based position in the sampling order; every row for ``n=None``.

    Rows are ranked inside hash buckets; the offset of a bucket is the number of rows in the
    buckets before it. Only the bucket counts (at most 16^``hash_digits`` rows, hence the
    broadcast) see a global window. Buckets that begin beyond ``n`` are dropped before anything is
    shuffled, so only the rows of the sample, and the rest of its last bucket, are. The hash spreads
    unique keys evenly, so no bucket is hot. ``frame`` is read twice, for the counts and for the
    ranks: pass a stored table.
    """
    hashed = frame.withColumn("_hash", seeded_hash(key, seed)).withColumn(
        "_bucket", F.conv(F.substring("_hash", 1, hash_digits), 16, 10).cast("bigint")
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    if n is not None:
        offsets = offsets.filter(F.col("_offset") < n)
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    ranked = (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn("rank", F.col("_offset") + F.row_number().over(inside))
        .drop("_hash", "_bucket", "_offset")
    )
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def sample_rows(frame: DataFrame, key: str, n: int | None, seed: int) -> DataFrame:
    """``min(n, all)`` rows; the same rows for the same seed, whatever the partitioning."""
    return sample_ranked(frame, key, n, seed).drop("rank")


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """(stratum, size, quota): ``n`` places (or all rows) shared in proportion to the strata's sizes.

    Every stratum gets the whole part of its share; what is left goes to the largest remainders, of
    equal ones to the smaller names. One row per stratum meets in one task, no row of the table.
    """
    total = F.sum("size").over(Window.partitionBy())
    whole = F.expr(f"({n} * CAST(size AS DECIMAL(38,0))) div total").cast("long")
    rest = F.expr(f"({n} * CAST(size AS DECIMAL(38,0))) % total")
    shared = sizes.withColumn("total", total).withColumns({"whole": whole, "rest": rest})
    left = F.lit(n) - F.sum("whole").over(Window.partitionBy())
    order = Window.orderBy(F.col("rest").desc(), F.col("stratum").asc_nulls_last())
    given = shared.withColumn("left", left).withColumn("place", F.row_number().over(order))
    quota = F.when(F.col("total") <= n, F.col("size")).otherwise(F.col("whole") + (F.col("place") <= F.col("left")).cast("int"))
    return given.select("stratum", "size", quota.alias("quota"))


def stratified_sample(frame: DataFrame, key: str, stratum: str, n: int, seed: int, hash_digits: int = HASH_DIGITS) -> DataFrame:
    """``min(n, all)`` rows, every stratum with its ``quota`` of them; ``rank`` is a row's place in its stratum.

    The sample of a stratum is its rows with the smallest hashes. Counts per stratum and hash bucket
    are added up where the rows are read; buckets beyond a quota are dropped before anything is
    shuffled, and the rest is ranked inside its buckets: a stratum with nearly all rows costs no task
    more than its share. A missing stratum is one of its own. ``frame`` is read twice: pass a stored
    table. Samples are the same on every partitioning, and that of fewer rows is part of that of more
    wherever the quotas are.
    """
    hashed = frame.withColumn("_hash", seeded_hash(key, seed)).withColumn(
        "_bucket", F.conv(F.substring("_hash", 1, hash_digits), 16, 10).cast("bigint")
    )
    counts = hashed.groupBy(F.col(stratum).alias("stratum"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shares = quotas(counts.groupBy("stratum").agg(F.sum("_n").alias("size")), n)
    same = F.col("c.stratum").eqNullSafe(F.col("q.stratum"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("c").join(shares.alias("q"), same)
    offsets = offsets.where("_offset < quota").select(F.col("c.stratum").alias("_stratum"), "_bucket", "_offset", "quota")
    inside = Window.partitionBy("_stratum", "_bucket").orderBy("_hash", key)
    met = hashed.withColumnRenamed("_bucket", "_b").join(offsets, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_b") == F.col("_bucket")))
    ranked = met.withColumn("rank", F.col("_offset") + F.row_number().over(inside)).where("rank <= quota")
    return ranked.drop("_hash", "_b", "_bucket", "_offset", "_stratum")


def with_batch(ranked: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive ranks in batches of ``batch_size``; the last one may be shorter."""
    return ranked.withColumn(
        "batch_id", F.floor((F.col("rank") - 1) / F.lit(batch_size)).cast("bigint")
    )
