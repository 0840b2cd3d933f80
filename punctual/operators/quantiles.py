"""Exact quantiles by counting: no sort, no window over rows, no collected values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of one histogram; a 50-bit range takes four or five of them, one inside the other.
BINS = 4_096
MICROSECONDS_PER_DAY = 86_400 * 1_000_000


class Wanted(NamedTuple):
    """The value at ``rank`` (from 0) of a group's values in order lies in ``low`` to ``high`` and is preceded by ``before`` smaller ones there."""

    group: str
    rank: int
    low: int
    high: int
    before: int = 0


def order_statistics(values: DataFrame, ranks: dict[str, list[int]], bounds: dict[str, tuple[int, int]], bins: int = BINS) -> dict[tuple[str, int], int]:
    """The values at the given ranks of every group of (group, value), value a long.

    Each round counts the values inside the still open ranges by equal bins and goes on with the bin
    that holds the rank, until a range is one number: one aggregate a round, of at most ``bins`` rows
    per open range, and only the chosen bins reach the driver. ``values`` is read once per round: pass
    a stored table.
    """
    spark = values.sparkSession
    open_, found = [Wanted(g, r, *bounds[g]) for g, some in ranks.items() for r in sorted(set(some))], {}
    while open_:
        for w in open_:
            if w.low == w.high:
                found[w.group, w.rank] = w.low
        open_ = [w for w in open_ if w.low < w.high]
        if not open_:
            break
        # Ranks that share a range share its histogram.
        ranges = sorted({(w.group, w.low, w.high, (w.high - w.low) // bins + 1) for w in open_})
        table = F.broadcast(spark.createDataFrame(ranges, "group string, low long, high long, width long"))
        counts = (
            values.join(table, "group")
            .where("value between low and high")
            .groupBy("group", "low", F.expr("(value - low) div width").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        in_range = Window.partitionBy("group", "low").orderBy("bin")
        before = counts.withColumn("before", F.sum("n").over(in_range) - F.col("n"))
        targets = F.broadcast(spark.createDataFrame(open_, "group string, rank long, low long, high long, skipped long"))
        chosen = before.join(targets, ["group", "low"]).where("rank - skipped >= before and rank - skipped < before + n")
        width = {(g, low, high): w for g, low, high, w in ranges}
        open_ = [
            Wanted(r.group, r.rank, r.low + r.bin * (w := width[r.group, r.low, r.high]), min(r.low + (r.bin + 1) * w - 1, r.high), r.skipped + r.before)
            for r in chosen.collect()
        ]
    return found


def gap_quantiles(features: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(delivery_outcome, n, share, gap_days): exact quantiles of the delivery gap per outcome, missing gaps left out.

    Between two values the quantile is interpolated. Gaps are whole microseconds, so they are counted
    as such. ``features`` is read several times, gap and outcome only: pass a stored table.
    """
    spark = features.sparkSession
    micros = F.rint(F.col("delivery_gap_days") * float(MICROSECONDS_PER_DAY)).cast("long")
    values = features.where("delivery_gap_days is not null").select(F.col("delivery_outcome").alias("group"), micros.alias("value"))
    known = {r.group: r for r in values.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    places = {(g, s): s * (r.n - 1) for g, r in known.items() for s in shares}
    ranks = {g: [x for s in shares for x in (int(places[g, s]), min(int(places[g, s]) + 1, r.n - 1))] for g, r in known.items()}
    exact = order_statistics(values, ranks, {g: (r.low, r.high) for g, r in known.items()})
    rows = []
    for (group, share), place in places.items():
        low, high = int(place), min(int(place) + 1, known[group].n - 1)
        below, above = (exact[group, r] / 1e6 / 86_400.0 for r in (low, high))
        rows.append((group, known[group].n, share, below + (above - below) * (place - low)))
    return spark.createDataFrame(rows, "delivery_outcome string, n long, share double, gap_days double")
