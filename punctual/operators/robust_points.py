"""One robust point per zip prefix: the geometric median, which a few misplaced points hardly move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.numeric import exact_sum
from punctual.operators.silver import zip_points
from punctual.sources.cache import materialize

#: A raw point nearer than this to the current one weighs as if it were that far away (degrees).
NEAREST = 1e-6
STEPS, TOLERANCE = 30, 1e-7


def robust_points(geolocation: DataFrame, path: str, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(zip_prefix, lat, lng, n): the point with the least sum of distances to the prefix's points, in degrees.

    Weiszfeld steps from the mean: each is one grouped aggregate of the raw points, weighted by the
    inverse distance to the current one, over all prefixes at once. Sums are decimals, so the points
    do not depend on partitioning. All prefixes go on until none moves by more than ``tolerance``, or
    for ``steps`` steps. Points that lack a coordinate are left out; a prefix without others has none.
    Each step's points, one row per prefix, are stored below ``path``; ``geolocation`` is read once per
    step: pass a stored table.
    """
    raw = geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("zip_prefix"), F.col("geolocation_lat").alias("x"), F.col("geolocation_lng").alias("y")
    ).where("zip_prefix is not null and x is not null and y is not null")
    present = geolocation.where("geolocation_lat is not null and geolocation_lng is not null and geolocation_zip_code_prefix is not null")
    points = materialize(zip_points(present), f"{path}/step=0")
    for step in range(1, steps + 1):
        far = F.sqrt((F.col("x") - F.col("lat")) ** 2 + (F.col("y") - F.col("lng")) ** 2)
        w = F.lit(1.0) / F.greatest(far, F.lit(NEAREST))
        # Deviations from the current point are added up, so that no digits are lost to its coordinates.
        moved = (
            raw.join(points.select("zip_prefix", "lat", "lng"), "zip_prefix")
            .select("zip_prefix", "lat", "lng", w.alias("w"), ((F.col("x") - F.col("lat")) * w).alias("wx"), ((F.col("y") - F.col("lng")) * w).alias("wy"))
            .groupBy("zip_prefix", "lat", "lng")
            .agg(F.count(F.lit(1)).alias("n"), *[exact_sum(F.col(c)).cast("double").alias(c) for c in ("w", "wx", "wy")])
            .withColumns({"dx": F.col("wx") / F.col("w"), "dy": F.col("wy") / F.col("w")})
            .select("zip_prefix", (F.col("lat") + F.col("dx")).alias("lat"), (F.col("lng") + F.col("dy")).alias("lng"), "n", F.greatest(F.abs("dx"), F.abs("dy")).alias("move"))
        )
        points = materialize(moved, f"{path}/step={step}")
        farthest = points.agg(F.max("move")).first()[0]
        if farthest is None or farthest <= tolerance:
            break
    return points.select("zip_prefix", "lat", "lng", "n")
