"""Crop by cells against the plain crop: the same pixels, far fewer ring tests."""

import math

import pytest
from pyspark.sql import functions as F

from scenelake.operators.cover import BORDER, INNER, area_windows, cover_blocks, crop_by_cover, with_states
from scenelake.operators.raster import crop

HEAD = "scene_id int, a double, b double, c double, d double, e double, f double, width int, height int, epsg int"
STAR = [(64 + (60 if k % 2 else 25) * math.cos(k * math.pi / 7), 64 + (60 if k % 2 else 25) * math.sin(k * math.pi / 7)) for k in range(14)]
SHAPES = {
    "star": [STAR],
    "hole": [[(3.2, 2.1), (125.0, 4.0), (120.0, 124.0), (5.0, 119.0)], [(40.0, 40.0), (80.0, 41.0), (60.0, 90.0)]],
    "on centres": [[(10.5, 10.5), (50.5, 10.5), (50.5, 50.5), (10.5, 50.5)]],
    "thin": [[(0.0, 0.0), (128.0, 126.0), (128.0, 127.0)]],
    "parts": [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0)], [(100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0)]],
    "beside": [[(500.0, 500.0), (510.0, 500.0), (505.0, 510.0)]],
}


@pytest.fixture(scope="module")
def world(spark):
    px = spark.range(128 * 128).selectExpr("1 as scene_id", "cast(id div 128 as int) as row", "cast(id % 128 as int) as col", "id as v")
    return px, spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 128, 128, 32644)], HEAD)


def areas(spark, shape):
    rings = [[(x + 1000.0, y + 1000.0) for x, y in [*r, r[0]]] for r in SHAPES[shape]]
    return spark.createDataFrame([(1, rings)], "scene_id int, rings array<array<struct<lon: double, lat: double>>>")


@pytest.mark.parametrize("shape", list(SHAPES))
def test_same_pixels(spark, world, shape):
    px, headers = world
    moved = headers.withColumns({"c": F.lit(1000.0), "f": F.lit(1000.0)})
    plain, cells = crop(px, moved, areas(spark, shape)), crop_by_cover(px, moved, areas(spark, shape), block=64, leaf=4)
    assert sorted(map(tuple, cells.pixels.collect())) == sorted(map(tuple, plain.pixels.collect()))
    assert cells.headers.collect() == plain.headers.collect()


def test_few_ring_tests(spark, world):
    px, headers = world
    moved = headers.withColumns({"c": F.lit(1000.0), "f": F.lit(1000.0)})
    windows = area_windows(moved, areas(spark, "hole")).select("scene_id", "a", "c", "e", "f", "rings", "row0", "row1", "col0", "col1")
    seen = {r["_state"]: r["count"] for r in with_states(px, cover_blocks(windows, 64, 4), 64, 4).groupBy("_state").count().collect()}
    assert seen[BORDER] < 0.25 * 128 * 128 < seen[INNER]
    joined = with_states(px, cover_blocks(windows, 64, 4), 64, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "block_row" in joined[joined.index("Join Inner") :].split("\n")[0]
