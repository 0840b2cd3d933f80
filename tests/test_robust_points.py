import math

import pytest
from pyspark.sql import functions as F

from punctual.operators.robust_points import robust_points
from punctual.operators.silver import zip_points

SCHEMA = "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, geolocation_state string"


def of(spark, path, rows, **options):
    frame = spark.createDataFrame([(z, x, y, "SP") for z, x, y in rows], SCHEMA)
    return {r.zip_prefix: (r.lat, r.lng, r.n) for r in robust_points(frame, str(path), **options).collect()}


def cost(p, points):
    return sum(math.dist(p, q) for q in points)


def test_one_far_outlier_does_not_move_the_point(spark, tmp_path):
    near = [(-23.5 + i % 3 / 100, -46.6 + i // 3 / 100) for i in range(9)]
    rows = [("a", *p) for p in near] + [("a", 60.0, 90.0)] + [("b", *p) for p in near] + [("c", 1.0, 2.0), ("d", None, 1.0), (None, 1.0, 1.0)]
    found = of(spark, tmp_path, rows, steps=12)
    assert set(found) == {"a", "b", "c"} and found["c"] == (1.0, 2.0, 1)
    assert math.dist(found["a"][:2], found["b"][:2]) < 0.01 and found["a"][2] == 10
    mean = spark.createDataFrame([(z, x, y, "SP") for z, x, y in rows], SCHEMA)
    assert zip_points(mean).filter(F.col("zip_prefix") == "a").first().lat > -16
    # No point nearby has a smaller sum of distances.
    points = [r[1:] for r in rows if r[0] == "a"]
    best = cost(found["a"][:2], points)
    for dx in (-0.003, 0.003):
        for dy in (-0.003, 0.003):
            assert cost((found["a"][0] + dx, found["a"][1] + dy), points) >= best - 1e-6


def test_equal_points_and_empty_tables(spark, tmp_path):
    assert of(spark, tmp_path / "x", [("a", 1.5, -2.5)] * 4)["a"] == pytest.approx((1.5, -2.5, 4))
    assert of(spark, tmp_path / "y", []) == {}
