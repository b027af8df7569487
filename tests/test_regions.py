"""Window filters, components and target boxes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import components as cc
from scenelake.operators import morphology as mo
from scenelake.operators import regions as rg


def cells(spark, mask, scene=1):
    h, w = mask.shape
    rows = [(scene, r, c, int(mask[r, c])) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "scene_id int, row int, col int, mask int")


def back(df, shape, value="mask"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r[value]
    return out


def brute(mask, size, kind):
    h, w = mask.shape
    b = size // 2
    lo, hi = (-b, size - 1 - b) if kind == "erode" else (-(size - 1 - b), b)
    out = np.zeros_like(mask)
    for r in range(h):
        for c in range(w):
            near = [mask[y, x] if 0 <= y < h and 0 <= x < w else 0 for y in range(r + lo, r + hi + 1) for x in range(c + lo, c + hi + 1)]
            out[r, c] = all(near) if kind == "erode" else any(near)
    return out


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_opening_and_closing(spark, size):
    mask = (np.random.default_rng(size).random((17, 13)) < 0.7).astype(int)
    opened = brute(brute(mask, size, "erode"), size, "dilate")
    closed = brute(brute(mask, size, "dilate"), size, "erode")
    df = cells(spark, mask)
    assert np.array_equal(back(mo.opening(df, size, block=6), mask.shape), opened)
    assert np.array_equal(back(mo.closing(df, size, block=6), mask.shape), closed)
    assert not (opened > mask).any()
    both = mo.filter_masks(
        df.withColumn("o", F.col("mask")).withColumn("c", F.col("mask")), {"o": mo.MaskFilter(size, False), "c": mo.MaskFilter(size, True)}, block=6
    )
    assert np.array_equal(back(both, mask.shape, "o"), opened) and np.array_equal(back(both, mask.shape, "c"), closed)


@pytest.mark.parametrize("size", [4, 5])
def test_density_mirrors_the_border(spark, size):
    mask = (np.random.default_rng(1).random((11, 14)) < 0.3).astype(int)
    padded = np.pad(mask, size, mode="symmetric")
    b = size // 2
    want = np.array([[padded[r + size - b : r + size - b + size, c + size - b : c + size - b + size].sum() for c in range(14)] for r in range(11)])
    header = spark.createDataFrame([(1, 11, 14)], "scene_id int, height int, width int")
    got = mo.density(cells(spark, mask), header, size, block=5)
    assert np.array_equal(back(got, mask.shape, "hits"), want) and got.count() == mask.size


def flood(mask):
    h, w = mask.shape
    label = -np.ones_like(mask)
    for r in range(h):
        for c in range(w):
            if mask[r, c] and label[r, c] < 0:
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < h and 0 <= x < w and mask[y, x] and label[y, x] < 0:
                        label[y, x] = r * w + c
                        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return label


def spiral(n):
    mask = np.zeros((n, n), dtype=int)
    r = c = 0
    dr, dc = 0, 1
    mask[0, 0] = 1
    for _ in range(n * n):
        y, x = r + dr, c + dc
        y2, x2 = r + 2 * dr, c + 2 * dc
        blocked = not (0 <= y < n and 0 <= x < n) or (0 <= y2 < n and 0 <= x2 < n and mask[y2, x2])
        if blocked:
            dr, dc = dc, -dr
            y, x = r + dr, c + dc
            if not (0 <= y < n and 0 <= x < n) or mask[y, x] or (0 <= r + 2 * dr < n and 0 <= c + 2 * dc < n and mask[r + 2 * dr, c + 2 * dc]):
                break
        r, c = y, x
        mask[r, c] = 1
    return mask


@pytest.mark.parametrize("mask", [spiral(21), (np.random.default_rng(3).random((30, 40)) < 0.6).astype(int), np.ones((9, 20), dtype=int)])
@pytest.mark.parametrize("block", [4, 7, 256])
def test_components_equal_flood_fill(spark, mask, block):
    got = cc.components(cells(spark, mask), block=block)
    label = -np.ones_like(mask)
    for r in got.collect():
        label[r["row"], r["col"]] = (r["label"] >> 32) * mask.shape[1] + (r["label"] & 0xFFFFFFFF)
    assert np.array_equal(label, flood(mask))


def test_component_sizes_sum_to_the_mask(spark):
    mask = (np.random.default_rng(8).random((25, 25)) < 0.5).astype(int)
    sizes = cc.component_sizes(cc.label_runs(cells(spark, mask), block=8))
    assert sizes.agg(F.sum("pixels")).first()[0] == mask.sum()


def test_empty_mask(spark):
    assert cc.components(cells(spark, np.zeros((5, 5), dtype=int))).count() == 0


def test_water_half_fills_the_lower_box(spark):
    px = spark.range(100 * 100).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col"))
    land = F.col("row") < 50
    px = px.withColumns({"r": F.when(land, 60).otherwise(10), "g": F.when(land, 90).otherwise(35), "b": F.when(land, 40).otherwise(80)})
    header = spark.createDataFrame([(1, 100, 100, 0.0001, 80.2, -0.0001, 13.15, 4326)], "scene_id int, height int, width int, a double, c double, e double, f double, epsg int")
    boxes = rg.target_regions(px, header, "water", 1)
    box = boxes.first()
    assert box["ymin"] >= 48 and box["ymax"] >= 97 and box["xmin"] <= 2 and box["xmax"] >= 97
    region = rg.ground(boxes, header, "water").first()
    assert region["label"] == "Water Body / Hydrological Basin #1" and abs(region["confidence"] - 0.91) < 1e-9
    assert 13.139 < region["min_lat"] < region["centroid_lat"] < region["max_lat"] < 13.15


def test_small_images_have_no_regions(spark):
    px = cells(spark, np.ones((8, 8), dtype=int)).select("scene_id", "row", "col", F.lit(10).alias("r"), F.lit(10).alias("g"), F.lit(10).alias("b"))
    header = spark.createDataFrame([(1, 8, 8)], "scene_id int, height int, width int")
    assert rg.target_regions(px, header, "water", min_side=10).count() == 0


def test_scenes_of_different_sizes_get_their_own_windows(spark):
    header = spark.createDataFrame([(1, 40, 40), (2, 240, 20)], "scene_id int, height int, width int")
    sizes = header.select("scene_id", rg._window(0.1, 2).alias("s")).collect()
    assert {r["scene_id"]: r["s"] for r in sizes} == {1: 4, 2: 2}
    rng = np.random.default_rng(4)
    parts = []
    for scene, shape in ((1, (40, 40)), (2, (240, 20))):
        parts.append(cells(spark, (rng.random(shape) < 0.8).astype(int), scene))
    both = parts[0].unionByName(parts[1]).withColumn("r", F.col("mask") * 10).withColumn("g", F.col("mask") * 40).withColumn("b", F.col("mask") * 90)
    together = rg.target_regions(both.drop("mask"), header, "water", 5).drop("feature")
    alone = None
    for scene in (1, 2):
        one = rg.target_regions(both.drop("mask").filter(F.col("scene_id") == scene), header.filter(F.col("scene_id") == scene), "water", 5).drop("feature")
        alone = one if alone is None else alone.unionByName(one)
    assert together.exceptAll(alone).count() == 0 and alone.exceptAll(together).count() == 0


def test_window_may_differ_by_scene(spark):
    rng = np.random.default_rng(3)
    sides = list(range(20, 44))
    masks = {i: rng.random((n, n)) < 0.6 for i, n in enumerate(sides)}
    rows = [(i, r, c, int(m[r, c])) for i, m in masks.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    df = spark.createDataFrame(rows, "scene_id int, row int, col int, mask int")
    size = F.element_at(F.array(*[F.lit(2 + k % 3) for k in range(len(sides))]), F.col("scene_id") + 1)
    got = mo.opening(df, size, block=16).collect()
    back = {i: np.zeros(m.shape, int) for i, m in masks.items()}
    for r in got:
        back[r["scene_id"]][r["row"], r["col"]] = r["mask"]
    for i, m in masks.items():
        one = df.filter(F.col("scene_id") == i) if i in (0, 7, 23) else None
        if one is not None:
            want = np.zeros(m.shape, int)
            for r in mo.opening(one, 2 + i % 3, block=64).collect():
                want[r["row"], r["col"]] = r["mask"]
            assert np.array_equal(back[i], want)


def test_one_large_scene(spark):
    """Two thousand pixels a side: a checkerboard of 50-pixel squares loses its specks and keeps its squares."""
    cells = spark.range(2000 * 2000).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 2000).cast("int").alias("row"), (F.col("id") % 2000).cast("int").alias("col"))
    square = (F.floor(F.col("row") / 50) + F.floor(F.col("col") / 50)) % 2 == 0
    speck = (F.col("row") % 50 == 25) & (F.col("col") % 50 == 25)
    df = cells.withColumn("mask", (square | speck).cast("int"))
    out = mo.opening(df, 24).agg(F.sum("mask").alias("n"), F.count("*").alias("all"), F.sum((F.col("mask") != square.cast("int")).cast("int")).alias("bad")).first()
    assert (out["n"], out["all"], out["bad"]) == (2_000_000, 4_000_000, 0)
