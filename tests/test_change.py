"""Two-date and two-sensor jobs on tiny rasters with known answers."""

from pyspark.sql import functions as F

from scenelake.operators import change as ch
from scenelake.plans.change_job import detect_change, index_change_job
from scenelake.plans.fusion_job import fuse


def grid(spark, h, w, scene=1):
    return spark.range(h * w).select(F.lit(scene).alias("scene_id"), F.floor(F.col("id") / w).alias("row"), (F.col("id") % w).alias("col"))


def header(spark, h, w):
    return spark.createDataFrame([(1, h, w)], "scene_id int, height int, width int")


def test_block_of_change_has_exact_area(spark):
    inside = F.col("row").between(20, 59) & F.col("col").between(30, 79)
    classed = grid(spark, 200, 200).withColumn("cls", F.when(inside, 1).otherwise(0))
    region = ch.class_regions(ch.class_extents(classed), header(spark, 200, 200)).first()
    assert (region["area_m2"], region["area_hectares"], region["area_km2"]) == (200000.0, 20.0, 0.2)
    assert (region["ymin"], region["xmin"]) == (10.0, 15.0)
    assert region["density"] == 1.0 and abs(region["confidence"] - 0.98) < 1e-12


def test_vegetation_loss_lowers_ndvi(spark):
    # Band values by role, so the infrared is infrared on both dates.
    t1 = grid(spark, 100, 100).withColumns({"b04": F.lit(40), "b03": F.lit(60), "b08": F.lit(200), "b11": F.lit(50)})
    t2 = grid(spark, 100, 100).withColumns({"b04": F.lit(180), "b03": F.lit(170), "b08": F.lit(50), "b11": F.lit(150)})
    row = ch.index_deltas(ch.pair_pixels(t1, t2, ["b03", "b04", "b08", "b11"])).first()
    assert row["ndvi_1"] > 0.4 and row["ndvi_2"] < 0 and row["delta_ndvi"] < -0.3
    assert row["indicators"][0].startswith("Vegetation Canopy Reduction (ΔNDVI: -")


def test_red_block_is_detected_and_nothing_is_made_up(spark):
    t1 = grid(spark, 300, 300).withColumns({c: F.lit(80) for c in "rgb"})
    inside = F.col("row").between(50, 149) & F.col("col").between(50, 149)
    t2 = t1.withColumn("r", F.when(inside, 240).otherwise(80))
    result = detect_change(t1, t2, header(spark, 300, 300))
    row = result.summary.first()
    assert row["changed_pixels"] == 10000 and row["has_significant_change"] and row["regions"] == 1
    assert "Built-up & Logistics Expansion: 100.0 ha" in row["description"]
    same = detect_change(t1, t1, header(spark, 300, 300))
    assert same.summary.first()["changed_pixels"] == 0 and same.regions.count() == 0


def test_common_extent_wins(spark):
    t1 = grid(spark, 10, 12).withColumns({c: F.lit(1) for c in "rgb"})
    t2 = grid(spark, 8, 20).withColumns({c: F.lit(1) for c in "rgb"})
    assert ch.pair_pixels(t1, t2, ("r", "g", "b")).count() == 8 * 12


def test_water_overrides_built(spark):
    rows = [(10, 10, 150, 250, 10, 20), (10, 10, 150, 250, 10, 120), (10, 250, 10, 5, 10, 10), (10, 10, 10, 12, 10, 10)]
    df = spark.createDataFrame(rows, "r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    assert [r["cls"] for r in ch.change_class(df).collect()] == [3, 1, 2, 0]


def test_index_change_job_text(spark):
    t1 = grid(spark, 4, 4).withColumns({"b04": F.lit(1.0), "b08": F.lit(1.0)})
    t2 = t1.withColumn("b08", F.when(F.col("row") < 2, 3.0).otherwise(1.0))
    areas = spark.createDataFrame([(1, 8.0, "2024-01-15", "2026-01-15")], "scene_id int, aoi_area_km2 double, before_date string, after_date string")
    row = index_change_job(t1, t2, areas, "ndvi").first()
    assert (row["improved_percent"], row["stable_percent"], row["declined_percent"]) == (50.0, 50.0, 0.0)
    assert row["improved_area_km2"] == 4.0
    assert row["summary"].startswith("8.00 km² between 2024-01-15 and 2026-01-15: Vegetation Growth / Greening on 50.0% (4.00 km²)")


def test_fusion_counts_and_evidence(spark):
    optical = grid(spark, 60, 60).withColumns({"r": F.lit(10), "g": F.lit(40), "b": F.lit(160)})
    radar = grid(spark, 50, 50).withColumns({"vv": F.lit(0.001), "vh": F.lit(0.0001)})
    result = fuse(optical, radar)
    row = result.summary.first()
    assert row["pixels"] == 2500 and row["o_water"] == 2500 and row["s_specular_water"] == 2500
    assert row["concordance_pct"] == 100.0 and row["structures"] == 0
    sources = {r["source"] for r in result.evidence.collect()}
    assert sources == {"optical", "sar", "combined"}


def test_regions_of_change_between_years(spark):
    from scenelake.plans.land_search import change_region_table

    rows = []
    for row in range(4):
        for col in range(4):
            for year in (2020, 2022, 2024):
                grown = year == 2024 and row < 2
                rows.append((1, row, col, year, 0.2, 0.8 if grown else 0.2, 0.1, 0.1))
    px = spark.createDataFrame(rows, "scene_id int, row int, col int, yr int, b04 double, b08 double, b03 double, b11 double")
    header = spark.createDataFrame([(1, 0.01, 77.0, -0.01, 12.0, 4326)], "scene_id int, a double, c double, e double, f double, epsg int")
    spans = spark.createDataFrame([(2020, 2024), (2020, 2022)], "from_year int, to_year int")
    got = change_region_table(px, header, "yr", spans).collect()
    assert [(r["target"], r["pixels"], r["temporal_persistence"]) for r in got] == [("land_use_change|2020|2024|vegetation_gain", 8, "2020-2024")]


def test_change_of_retrieved_pairs(spark):
    from scenelake.plans.retrieval import retrieve_change

    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", None)], "query_id int, before_product_id string, after_product_id string")
    rows = [(p, r, c, 10 + 200 * (p == "b" and r == 0), 10, 10) for p in ("a", "b", "c") for r in range(4) for c in range(4)]
    px = spark.createDataFrame(rows, "product_id string, row int, col int, r int, g int, b int")
    headers = spark.createDataFrame([(p, 4, 4) for p in "abc"], "product_id string, height int, width int")
    got = {r["query_id"]: (r["pixels"], r["changed_pixels"]) for r in retrieve_change(pairs, px, headers).collect()}
    assert got == {1: (16, 4), 2: (16, 4)}
