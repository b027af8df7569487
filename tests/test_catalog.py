"""Catalog, stores, feeds, candidates and ranking."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scenelake.operators import candidates as cd
from scenelake.operators import catalog as cat
from scenelake.operators.ranking import rank_within, top_k
from scenelake.registry import Tool, Toolbox, default_toolbox
from scenelake.sources import files, geojson, stac, store
from scenelake.sources.provider import FolderProvider
from scenelake.streaming.catalog_feed import read_feed, start_feed


def scenes(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", 45.0, "S2MSI2A", day(10), 1), ("b", 2.4, "S2MSI2A", day(15), 2), ("c", 2.0, "S2MSI1C", day(15), 3)]
    df = spark.createDataFrame(rows, "product_id string, cloud double, product_type string, acquired_at timestamp_ntz, ord int")
    return df.withColumns(
        {
            "sensor": F.lit("Sentinel-2 MSI"), "collection": F.lit("SENTINEL-2"), "overlap": F.lit(100.0), "request_id": F.lit(1),
            "target_date": F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"),
        }
    )


def test_calibrated_clear_scene_ranks_first(spark):
    ranked = cat.rank_scenes(scenes(spark)).orderBy("rank").collect()
    assert [r["product_id"] for r in ranked] == ["b", "c", "a"]
    assert ranked[0]["is_selected"] and ranked[0]["score"] > 0.8
    assert ranked[0]["reason"].startswith("Selected for optimal observation quality: exceptional clear-sky quality (2.4% cloud)")
    assert ranked[1]["reason"].startswith("Candidate rank #2 (Score: 0.")
    assert cat.best_scene(scenes(spark)).first()["product_id"] == "b"


def test_filters_reject_bad_input(spark):
    with pytest.raises(ValueError):
        cat.filter_scenes(scenes(spark), start="2024-02-01", end="2024-01-01")
    with pytest.raises(ValueError):
        cat.filter_scenes(scenes(spark), limit=0)
    kept = cat.filter_scenes(scenes(spark), start="2024-01-15", end="2024-01-15", max_cloud=2.4, limit=1)
    assert [r["product_id"] for r in kept.collect()] == ["c"]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "cat")
    scenes(spark).write.parquet(path)
    plan = cat.filter_scenes(spark.read.parquet(path), start="2024-01-11", max_cloud=10.0, collection="SENTINEL-2")
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = text.split("PushedFilters")[1]
    assert "collection" in pushed and "acquired_at" in pushed


def test_pair_reasons(spark):
    pair = cat.best_pair(scenes(spark).filter("product_id = 'a'"), scenes(spark).filter("product_id <> 'a'")).first()
    assert pair["before_reason"].startswith("Optimal Baseline (T1): ") and pair["after_product_id"] == "b"
    half = cat.best_pair(scenes(spark).filter("product_id = 'a'"), scenes(spark).filter("false")).first()
    assert half["after_product_id"] is None and not half["before_reason"].startswith("Optimal")


@pytest.mark.parametrize("values", ["spread", "ties", "one"])
def test_rank_of_a_large_group_is_exact(spark, values):
    rng = random.Random(7)
    pick = {"spread": lambda: rng.random(), "ties": lambda: float(rng.randint(0, 3)), "one": lambda: 1.0}[values]
    rows = [(1, pick(), i) for i in range(4000)] + [(2, pick(), i) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, v double, id int")
    named = df.withColumn("id", F.format_string("%d-%05d", "k", "id"))
    by_name = {(r["k"], int(r["id"][2:])): r["rank"] for r in rank_within(named, ["k"], F.col("v"), ["id"], large_group=50).collect()}
    got = {(r["k"], r["id"]): r["rank"] for r in rank_within(df, ["k"], F.col("v"), ["id"], large_group=50).collect()}
    assert got == by_name
    for k in (1, 2):
        order = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]))
        assert [got[(k, r[2])] for r in order] == list(range(1, len(order) + 1))


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    best = top_k(df, ["k"], [F.col("id").desc()], 2)
    assert sorted(r["id"] for r in best.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_store_keeps_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "store")
    first = store.with_key(spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 3)], "product_id string, n int"))
    store.put_products(first, path, spark)
    assert spark.read.parquet(path).count() == 2
    store.put_products(store.with_key(spark.createDataFrame([("p2", 9), ("p3", 4)], "product_id string, n int")), path, spark)
    assert sorted(r["product_id"] for r in spark.read.parquet(path).collect()) == ["p1", "p2", "p3"]
    for n in (7, 2):
        store.put_products(store.with_key(spark.createDataFrame([("p3", n)], "product_id string, n int")), path, spark, force_refresh=True)
        assert store.latest(spark.read.parquet(path)).filter("product_id = 'p3'").first()["n"] == n
    assert store.cached_products(first, spark.read.parquet(path)).count() == 3
    store.clear_store(path, spark)
    assert store.latest(spark.read.parquet(path)).count() == 0


def test_cache_key_is_the_hash_prefix(spark):
    import hashlib

    df = spark.createDataFrame([("S2A_X", 77.53, 11.23, 77.635, 11.32)], "product_id string, a double, b double, c double, d double")
    key = df.select(cat.cache_key("product_id", ["a", "b", "c", "d"])).first()[0]
    assert key == hashlib.sha256(b"S2A_X_[77.53, 11.23, 77.635, 11.32]").hexdigest()[:16]


FEATURES = {
    "type": "FeatureCollection",
    "features": [
        {"id": "one", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-01-15T05:00:00Z", "eo:cloud_cover": 3.14, "grid:code": "T43"}},
        {"properties": {"id": "two", "start_datetime": "2024-02-01T00:00:00Z", "cloudCoverage": 8.0, "platform": "Sentinel-2A", "mgrs": "T44"}},
        {"id": "one", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-01-15T05:00:00Z"}},
    ],
}


def catalog_folder(tmp_path):
    folder = tmp_path / "stac"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(FEATURES))
    return str(folder)


def test_stac_fallbacks(spark, tmp_path):
    rows = stac.read_stac(spark, catalog_folder(tmp_path), default_bbox=[0, 0, 9, 9]).collect()
    one, two = rows[0], rows[1]
    assert (one["product_id"], one["cloud"], one["tile_id"], one["platform"], one["x1"]) == ("one", 3.1, "T43", "Sentinel-2B", 3.0)
    assert (two["product_id"], two["cloud"], two["tile_id"], two["platform"], two["x1"]) == ("two", 8.0, "T44", "Sentinel-2A", 9.0)
    assert rows[2]["cloud"] == 0.0 and rows[2]["tile_id"] == "T44N" and two["bands"][:2] == ["B02", "B03"]


def test_feed_deduplicates_across_batches(spark, tmp_path):
    folder = catalog_folder(tmp_path)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for _ in range(2):
        query = start_feed(read_feed(spark, folder), out, ckpt, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        (tmp_path / "stac" / "b.json").write_text(json.dumps(FEATURES))
    assert sorted(r["product_id"] for r in spark.read.parquet(out).collect()) == ["one", "two"]
    old = {"features": [{"id": "old", "properties": {"datetime": "2019-01-01T00:00:00Z"}}]}
    (tmp_path / "stac" / "c.json").write_text(json.dumps(old))
    start_feed(read_feed(spark, folder), out, ckpt, available_now=True).awaitTermination(120)
    assert sorted(r["product_id"] for r in spark.read.parquet(out).collect()) == ["old", "one", "two"]


def test_provider(spark, tmp_path):
    folder = catalog_folder(tmp_path)
    provider = FolderProvider(folder)
    assert provider.search(spark, max_cloud=5.0).count() == 2
    assert provider.get_product(spark, "two").count() == 1
    assert provider.get_product(spark, "it's").count() == 0


def test_file_audit(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "S1_sar.tif").write_bytes(b"II*\x00" + b"0" * 2000)
    (folder / "bad.png").write_bytes(b"nope")
    (folder / "notes.txt").write_text("x")
    got = {r["filename"]: r for r in files.audit_files(spark, str(folder), signature=True).collect()}
    assert {n: r["status"] for n, r in got.items()} == {
        "S1_sar.tif": "VALID", "bad.png": "CORRUPTED_FILE", "notes.txt": "UNSUPPORTED_FORMAT",
    }
    assert got["S1_sar.tif"]["modality"] == "SAR" and got["S1_sar.tif"]["size_text"] == "2.0 KB"
    assert files.newest_file(spark, str(folder)).first()["path"]


def test_geojson_sink(spark, tmp_path):
    from scenelake.functions.geometry import box_ring

    path = str(tmp_path / "features")
    df = spark.createDataFrame([(1, "x")], "id int, name string").withColumn("ring", box_ring(0.1234567, 1.0, 2.0, 3.0))
    geojson.write_features(df, path, "ring", ["id", "name"])
    feature = json.loads(spark.read.text(path).first()[0])
    assert feature["geometry"]["coordinates"][0][0] == [0.12346, 1.0] and len(feature["geometry"]["coordinates"][0]) == 5
    assert feature["properties"] == {"id": 1, "name": "x"}


def test_followup_keeps_large_candidates(spark):
    cand = spark.createDataFrame([(1, 1, 5.0, 2.0, 0.9, "a"), (1, 2, 2.0, 1.0, 0.5, "b")], "search_id int, cand_id int, area_hectares double, distance_km double, persistence_ratio double, name string")
    ask = lambda text: spark.createDataFrame([(1, text)], "search_id int, prompt string")
    assert [r["cand_id"] for r in cd.refine_candidates(cand, ask("only larger than 3 hectares")).collect()] == [1]
    near = cd.refine_candidates(cand, ask("Which one is closest?"))
    assert [r["cand_id"] for r in near.orderBy("position").collect()] == [2, 1]
    assert "'b', 1.0 km" in cd.refine_reply(near).first()["reply"]


def test_mirrored_regions_keep_the_order_of_their_ids(spark):
    """Equal distances differ in the last bit only; ids decide, in the follow-up, the nearest one and the land search."""
    from scenelake.plans.land_search import _rank_by_request

    far = 4.6897768780715
    rows = [(1, "73-12", 1.0, far, 1.0, "b", 5), (1, "48-42", 1.0, math.nextafter(far, 9), 1.0, "a", 4), (1, "9-1", 1.0, 1.0, 1.0, "c", 9)]
    cand = spark.createDataFrame(rows, "search_id int, cand_id string, area_hectares double, distance_km double, persistence_ratio double, name string, label int")
    near = cd.refine_candidates(cand, spark.createDataFrame([(1, "the closest one")], "search_id int, prompt string"))
    assert [r["cand_id"] for r in near.orderBy("position").collect()] == ["9-1", "48-42", "73-12"]
    assert cd.nearest(cand.filter("label < 9")).first()["cand_id"] == "48-42"
    named = cand.selectExpr("1 as spec", "'distance_asc' as ranking_criteria", "*", "'t' as target", "label as scene_id")
    assert [r["cand_id"] for r in _rank_by_request(named).orderBy("rank").collect()] == ["9-1", "48-42", "73-12"]


def test_toolbox(spark):
    box = default_toolbox()
    box.register(Tool("Captioning", "replaced", [], ["SINGLE_CAPTION"], lambda df: df))
    assert isinstance(box, Toolbox) and box.get("Captioning").description == "replaced" and box.get("nope") is None
    assert box.table(spark).count() == len(box.names())
