"""Indices, statistics, display and radar on tiny rasters with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.functions import indices as ix
from scenelake.functions import optical as opt
from scenelake.functions import radar as sar
from scenelake.operators import display, stats
from scenelake.operators.quantiles import counted_quantiles, quantiles
from scenelake.plans.index_product import index_layer
from scenelake.sources.pixels import nodata_to_null, scan_bands, write_pixels


def raster(spark, size=8, **bands):
    df = spark.range(size * size).select(
        F.lit(1).alias("scene_id"), F.floor(F.col("id") / size).alias("row"), (F.col("id") % size).alias("col")
    )
    return df.withColumns({name: F.lit(float(value)) for name, value in bands.items()})


def stat(df, index):
    return stats.index_stats(df, (index,)).first()


def test_ndvi_of_a_green_field(spark):
    row = stat(raster(spark, b04=500, b08=4000), "ndvi")
    assert round(row["mean"], 2) == 0.78
    assert row["shares"]["vegetated_pct"] == 100.0
    assert row["class_breakdown"]["Healthy Vegetation (NDVI > 0.50)"] == 100.0


def test_ndwi_and_ndbi_known_values(spark):
    row = stat(raster(spark, b03=1500, b08=500), "ndwi")
    assert round(row["mean"], 2) == 0.50 and row["shares"]["water_body_pct"] == 100.0
    assert round(stat(raster(spark, b08=1000, b11=2500), "ndbi")["mean"], 2) == 0.43


def test_zero_missing_and_nan_bands(spark):
    rows = [(0.0, 0.0), (None, 1.0), (float("nan"), 1.0), (2.0, -2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(ix.normalized_difference("a", "b")).collect()]
    assert got == [0.0, None, 0.0, 1.0]
    raw = df.select(ix.normalized_difference("a", "b", nan_to_zero=False)).collect()
    assert raw[2][0] is None


def test_missing_band_fails_instead_of_guessing(spark):
    with pytest.raises(Exception, match="b11"):
        stats.index_stats(raster(spark, b08=1), ("ndbi",))


def test_class_percentages_sum_to_hundred(spark):
    df = raster(spark, 16, b04=1).withColumn("b08", (F.col("row") * 16 + F.col("col")) / 100.0)
    row = stat(df, "ndvi")
    assert abs(sum(row["class_breakdown"].values()) - 100.0) < 1e-9
    layer = index_layer(df, "ndvi")
    assert layer.filter("legend is null or class is null").count() == 0


def test_band_stats_without_a_valid_pixel(spark):
    px = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 2, 8.0)], "scene_id int, band int, value double")
    got = {r["band"]: r for r in stats.band_stats(px).collect()}
    assert (got[1]["min"], got[1]["max"], got[1]["mean"], got[1]["std"]) == (0.0, 255.0, 128.0, 0.0)
    assert (got[2]["mean"], got[2]["std"]) == (6.0, 2.0)


def test_scan_reads_only_the_bands(spark, tmp_path):
    path = str(tmp_path / "px")
    raster(spark, b02=1, b03=2, b04=3).write.parquet(path)
    df = scan_bands(spark, path, ["b04", "b99"])
    assert df.columns == ["scene_id", "row", "col", "b04"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "b02" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        scan_bands(spark, path, ["b99"])


def test_pixel_layout_round_trip(spark, tmp_path):
    px = nodata_to_null(raster(spark, b04=7, b08=-9999), ["b04", "b08"], -9999)
    px = px.withColumn("collection", F.lit("S2")).withColumn("month", F.lit("2024-01"))
    write_pixels(px, str(tmp_path / "px"))
    back = spark.read.parquet(str(tmp_path / "px"))
    assert back.count() == 64 and back.filter("b08 is null and b04 = 7").count() == 64


@pytest.mark.parametrize("n", [1, 2, 3, 999, 40000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(3.0, n), 3)
    df = spark.createDataFrame([(1, float(x)) for x in values], "k int, v double").unionByName(
        spark.createDataFrame([(2, 5.0), (2, 5.0), (2, None)], "k int, v double")
    )
    probs = (0.0, 0.01, 0.02, 0.5, 0.98, 0.99, 1.0)
    names = [f"p{i}" for i in range(len(probs))]
    # A coarse sketch forces the bracket path for the larger inputs.
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", probs, names, accuracy=400).collect()}
    for p, name in zip(probs, names):
        assert got[1][name] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)
        assert got[2][name] == 5.0


def test_quantiles_when_one_value_dominates(spark):
    values = [1.0] * 30000 + [float(i) for i in range(2, 3000)]
    df = spark.createDataFrame([(1, x) for x in values], "k int, v double")
    row = quantiles(df, ["k"], "v", (0.02, 0.5, 0.98), ("a", "b", "c"), accuracy=300).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx([float(np.quantile(values, p)) for p in (0.02, 0.5, 0.98)])


def test_counted_quantiles(spark):
    counts = spark.createDataFrame([(1, 0, 3), (1, 5, 1), (1, 9, 6)], "k int, v int, n bigint")
    row = counted_quantiles(counts, ["k"], "v", [0.01, 0.35, 0.99], ["a", "b", "c"]).first()
    data = [0] * 3 + [5] + [9] * 6
    assert [row["a"], row["b"], row["c"]] == pytest.approx([np.quantile(data, p) for p in (0.01, 0.35, 0.99)])


def test_stretch_edges(spark):
    flat = raster(spark, v=3.0)
    assert {r[0] for r in display.stretch(flat, "v").select("byte").collect()} == {0}
    empty = raster(spark, v=0.0)
    assert {r[0] for r in display.stretch(empty, "v").select("byte").collect()} == {0}
    ramp = raster(spark, 10, v=0).withColumn("v", F.col("row") * 10 + F.col("col") + 1.0)
    got = [r[0] for r in display.stretch(ramp, "v").select("byte").orderBy("row", "col").collect()]
    values = np.arange(1, 101, dtype=float)
    lo, hi = np.quantile(values, 0.02), np.quantile(values, 0.98)
    assert got == list((np.clip((values - lo) / (hi - lo), 0, 1) * 255).astype(int))


def test_radar_block_is_a_structure_and_the_rest_water(spark):
    inside = F.col("row").between(10, 29) & F.col("col").between(10, 29)
    px = raster(spark, 50, vh=0.001).withColumn("vv", F.when(inside, 0.5).otherwise(0.001))
    db = display.radar_to_db(px)
    masks = db.select(*[c.alias(n) for n, c in sar.backscatter_masks().items()])
    row = masks.agg(F.count_if("double_bounce").alias("b"), F.count_if("specular_water").alias("w")).first()
    assert (row["b"], row["w"]) == (400, 2100)
    again = display.radar_to_db(db)
    assert again.exceptAll(db).count() == 0


def test_single_polarisation_is_grey(spark):
    px = raster(spark, 8, vv=0).withColumn("vv", -F.col("row") * 8.0 - F.col("col")).withColumn("vh", F.lit(None).cast("double"))
    rgb = display.radar_composite(px)
    assert rgb.filter("r <> g or g <> b").count() == 0


def test_optical_halves(spark):
    px = raster(spark, 60).withColumns(
        {"r": F.when(F.col("row") < 30, 30).otherwise(10), "g": F.when(F.col("row") < 30, 180).otherwise(40), "b": F.when(F.col("row") < 30, 40).otherwise(160)}
    )
    norm = display.normalize_reflectance(px)
    masks = opt.reflectance_masks()
    row = norm.agg(F.count_if(masks["vegetation"]).alias("v"), F.count_if(masks["water"]).alias("w")).first()
    assert (row["v"], row["w"]) == (1800, 1800)


def test_captions(spark):
    s = stats.index_stats(raster(spark, b03=1, b04=500, b08=4000, b11=1))
    assert "100.0% active vegetation canopy (mean NDVI 0.78)" in stats.scene_caption(s).first()["caption"]
    df = spark.createDataFrame([(1, 3), (2, 0)], "scene_id int, structures int")
    captions = [r["caption"] for r in stats.radar_caption(df).orderBy("scene_id").collect()]
    assert "3 high-intensity" in captions[0] and "without" in captions[1]
