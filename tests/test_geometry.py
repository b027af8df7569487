"""Geometry, coordinate systems, tiles, resampling and footprints against hand-made answers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scenelake.functions import crs
from scenelake.functions import geometry as geo
from scenelake.operators import overlap, raster

HEADER = "scene_id int, a double, b double, c double, d double, e double, f double, width int, height int, epsg int"


def test_known_utm_and_mercator_places(spark):
    # A point on the central meridian and the textbook CN Tower coordinate (zone 17 north).
    df = spark.createDataFrame([(3.0, 0.0, 32631), (-79.387139, 43.642567, 32617), (180.0, 0.0, 3857)], "lon double, lat double, epsg int")
    got = [r["p"] for r in df.select(crs.from_wgs84("lon", "lat", "epsg").alias("p")).collect()]
    assert got[0]["x"] == pytest.approx(500000.0, abs=1e-6) and got[0]["y"] == pytest.approx(0.0, abs=1e-6)
    assert got[1]["x"] == pytest.approx(630084.3, abs=1.0) and got[1]["y"] == pytest.approx(4833438.6, abs=1.0)
    assert got[2]["x"] == pytest.approx(20037508.342789, abs=1e-3)


def test_unknown_code_fails(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "lon double, lat double")
    with pytest.raises(Exception, match="unsupported EPSG code 2154"):
        df.select(crs.from_wgs84("lon", "lat", 2154)).collect()


def test_area_of_a_small_place(spark):
    ring = raster.literal_ring([(77.53, 11.23), (77.635, 11.23), (77.635, 11.32), (77.53, 11.32)])
    row = spark.range(1).select(geo.polygon_area_km2(ring).alias("km2"), geo.polygon_area_km2(F.slice(ring, 1, 2)).alias("none")).first()
    assert 110 < row["km2"] < 120 and row["none"] == 0.0


def test_area_inputs(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(raster.geojson_ring("t"))).first()[0] == 4
    with pytest.raises(ValueError):
        raster.literal_ring([(0, 0), (1, 1)])
    many = '{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]],[[[9,9],[10,9],[10,10],[9,9]]]]}'
    df = spark.createDataFrame([(text,), (many,)], "t string")
    assert [r[0] for r in df.select(F.size(raster.geojson_rings("t"))).collect()] == [1, 3]
    for bad in ('{"type":"Point","coordinates":[1,2]}', "nonsense", None):
        with pytest.raises(Exception, match="not a polygon"):
            spark.createDataFrame([(bad,)], "t string").select(raster.geojson_rings("t")).collect()


def test_turned_raster_is_refused(spark):
    header = spark.createDataFrame([(1, 1.0, 0.5, 0.0, 0.0, -1.0, 0.0, 9, 9, 4326)], HEADER)
    px = spark.range(9).selectExpr("1 as scene_id", "id as row", "id as col")
    with pytest.raises(Exception, match="turned against its axes"):
        raster.crop(px, header, [0.0, -5.0, 5.0, 0.0]).pixels.collect()


def test_crop_projects_degrees_onto_a_projected_raster(spark):
    header = spark.createDataFrame([(1, 100.0, 0.0, 500000.0, 0.0, -100.0, 1001000.0, 20, 10, 32631)], HEADER)
    px = spark.range(200).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.lit(1.0).alias("v"))
    inverse = header.select(
        crs.to_wgs84(F.lit(500410.0), F.lit(1000360.0), 32631).alias("p"), crs.to_wgs84(F.lit(501260.0), F.lit(1000860.0), 32631).alias("q")
    ).first()
    box = [inverse["p"]["lon"], inverse["p"]["lat"], inverse["q"]["lon"], inverse["q"]["lat"]]
    done = raster.crop(px, header, box)
    new = done.headers.first()
    assert (new["c"], new["f"]) == (500400.0, 1000900.0)
    # Centres at 450..1250 m east and 450..850 m north.
    assert done.pixels.count() == 9 * 5


@pytest.mark.parametrize(("size", "overlap_px"), [(4, 1), (5, 0), (4, 4)])
def test_tiles_cover_every_pixel(spark, size, overlap_px):
    header = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 11, 9, 4326)], HEADER)
    px = spark.range(99).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 11).alias("row"), (F.col("id") % 11).alias("col"))
    tiles = raster.tile_manifest(header, size, overlap_px)
    joined = px.join(
        tiles.drop("c", "f"),
        (px.row >= tiles.row_off) & (px.row < tiles.row_off + tiles.tile_height) & (px.col >= tiles.col_off) & (px.col < tiles.col_off + tiles.tile_width),
    ).select("row", "col", "row_index", "col_index")
    mine = raster.assign_tiles(px, size, overlap_px).select("row", "col", "row_index", "col_index")
    assert mine.exceptAll(joined).count() == 0 and joined.exceptAll(mine).count() == 0
    assert mine.select("row", "col").distinct().count() == 99


def test_stack_with_a_coarse_band(spark):
    fine = spark.range(64).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / 8).alias("row"), (F.col("id") % 8).alias("col"))
    coarse = fine.filter("row < 4 and col < 4").withColumn("B11", F.lit(7.0))
    src = spark.createDataFrame([(1, 20.0, 0.0, 0.0, 0.0, -20.0, 0.0, 4, 4, 32631)], HEADER)
    ref = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, 8, 8, 32631)], HEADER)
    swir = raster.resample(coarse, src, ref, ["B11"]).select("scene_id", "row", "col", F.lit("B11").alias("band"), F.col("B11").alias("value"))
    assert swir.count() == 64 and swir.filter("abs(value - 7) > 1e-9").count() == 0
    others = [fine.select("scene_id", "row", "col", F.lit(b).alias("band"), F.lit(1.0).alias("value")) for b in ("B08", "B02", "B03", "B04")]
    long = swir
    for df in others:
        long = long.unionByName(df)
    stacked = raster.stack_bands(long, ["B11", "B08", "B02", "B03", "B04"])
    assert stacked.columns == ["scene_id", "row", "col", "B02", "B03", "B04", "B08", "B11"] and stacked.count() == 64


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(5)
    # A third of the footprints are one repeated tile.
    boxes = [(i, x := rng.uniform(-9, 9), y := rng.uniform(-9, 9), x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for i in range(80)]
    boxes += [(100 + i, 1.0, 1.0, 2.0, 2.0) for i in range(40)]
    df = spark.createDataFrame(boxes, "id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["id_a"], r["id_b"]) for r in overlap.overlap_join(df, df, "id", "id", cell=0.7).collect()}
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert got == want


def test_overlap_pairs_are_made_last(spark):
    """Repeat passes: what is shuffled grows with the boxes, not with their pairs; null and repeated ids, ids beyond one array."""
    where = [(0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 3.0, 2.5), (9.0, 9.0, 9.5, 9.5), (-0.2, 0.1, 0.0, 0.9), (None, 0.0, 1.0, 1.0)]
    scenes = [(k if k % 50 else None, *where[k % 7 % 5]) for k in range(700)] + [(3, *where[0])] * 300
    areas = [(k, *where[k % 5]) for k in range(40)] + [(7, *where[1]), (7, *where[1]), (None, *where[0])]
    box = "x0 double, y0 double, x1 double, y1 double"
    a, b = spark.createDataFrame(scenes, f"s long, {box}"), spark.createDataFrame(areas, f"t long, {box}")

    def shared(p, q):
        if None in p[1:] or None in q[1:]:
            return None
        w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
        return w * h if w >= 0 and h >= 0 else None

    size = lambda p: (p[3] - p[1]) * (p[4] - p[2])
    want, covered = Counter(), Counter()
    for p in scenes:
        for q in areas:
            if (s := shared(p, q)) is not None:
                want[p[0], q[0], round(s, 9), round(s * 100 / min(size(p), size(q)), 9)] += 1
                for r in areas:
                    if q[0] is not None and r[0] == q[0] and r[1] is not None:
                        covered[p[0], q[0], round(s * 100 / size(r), 9)] += 1
    joined, part = overlap.overlap_join(a, b, "s", "t"), overlap.scene_aoi_overlap(a, b, "s", "t", cell=0.7)
    assert Counter((r.id_a, r.id_b, round(r.shared, 9), round(r.overlap_pct, 9)) for r in joined.collect()) == want
    assert Counter((r.scene_id, r.aoi_id, round(r.overlap_pct, 9)) for r in part.collect()) == covered
    for df in (joined, part):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan[: plan.index("Join")].count("Generate explode") == 2


def test_pair_ratings(spark):
    cols = "scene_id int, crs string, res double, x0 double, y0 double, x1 double, y1 double, width int, height int, modality string"
    rows = [
        (1, "EPSG:32644", 10.0, 0.0, 0.0, 10.0, 10.0, 5, 5, "Optical"),
        (2, "EPSG:32644", 10.0, 0.0, 0.0, 10.0, 10.0, 5, 5, "SAR"),
        (3, "EPSG:4326", 20.0, 50.0, 50.0, 60.0, 60.0, 6, 5, "Optical"),
    ]
    headers = spark.createDataFrame(rows, cols)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a int, id_b int")
    rated = {r["id_b"]: r for r in overlap.alignment_rating(headers, pairs).collect()}
    assert rated[2]["alignment_rating"] == "PERFECT_PIXEL_MATCH" and rated[3]["alignment_rating"] == "REQUIRES_RESAMPLING"
    checked = {r["id_b"]: r for r in overlap.validate_pairs(headers, pairs).collect()}
    assert checked[2]["pair_type"] == "Cross-Modal (Optical + SAR)" and checked[2]["overlap_percentage"] == 100.0
    assert not checked[3]["is_compatible"] and checked[3]["errors"] and len(checked[3]["warnings"]) == 2
