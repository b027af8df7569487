"""Field extraction, routing, box parsing and reports on known sentences."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scenelake.functions import boxes as bx
from scenelake.functions import text as tx
from scenelake.operators import box_text, gazetteer
from scenelake.operators import history as hs
from scenelake.operators import query_text as qt

PLACES = [("perundurai", 1, "Perundurai", 11.275, 77.5833), ("erode", 2, "Erode", 11.341, 77.7172), ("erode east", 3, "Erode East", 11.4, 77.8)]


@pytest.fixture(scope="module")
def gaz(spark):
    return spark.createDataFrame(PLACES, "key string, ord int, name string, lat double, lon double")


def texts(spark, *lines):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "query_id int, text string")


def test_land_queries(spark, gaz):
    df = texts(
        spark,
        "Find potentially vacant land around Perundurai",
        "Show bare land within 10 km of Erode",
        "Which areas have poor vegetation near Erode?",
        "Show land change from 2022 to 2026 in Perundurai",
        "Show me land for sale in Erode",
        "open plots larger than 5 acres in Atlantis",
    )
    got = {r["query_id"]: r for r in qt.parse_land_queries(df, gaz).collect()}
    assert (got[0]["intent"], got[0]["location"], got[0]["radius_km"]) == ("vacant_land_search", "Perundurai", 6.0)
    assert (got[1]["intent"], got[1]["radius_km"]) == ("vacant_land_search", 10.0)
    assert (got[2]["intent"], got[2]["target"]) == ("vegetation_analysis", "low_vegetation_health")
    assert (got[3]["intent"], got[3]["from_year"], got[3]["to_year"]) == ("temporal_change", 2022, 2026)
    assert not got[4]["is_supported"] and got[4]["unsupported_reason"]
    assert got[5]["location"] == "Atlantis" and got[5]["lat"] is None
    assert got[5]["minimum_area_hectares"] == pytest.approx(2.0234, abs=1e-4)


def test_retrieval_dates(spark, gaz):
    df = texts(spark, "Compare Perundurai between January 2024 and August 2026", "Radar image of Erode", "Compare Erode 2026 and 2020")
    got = {r["query_id"]: r for r in qt.parse_retrieval_queries(df, gaz).collect()}
    assert (got[0]["date_a"], got[0]["date_b"], got[0]["task"]) == ("2024-01-15", "2026-01-15", "Bi-Temporal Change Analysis")
    assert (got[1]["sensor"], got[1]["task"]) == ("Sentinel-1 SAR C-Band", "SAR Radar Analysis")
    assert (got[2]["date_a"], got[2]["date_b"]) == ("2020-01-15", "2026-01-15")


def test_routing(spark):
    df = texts(spark, "What terrain is this?", "Describe the scene", "Highlight water", "What changed here?", "Analyze optical and SAR together")
    tasks = [r["task"] for r in qt.route_tasks(df).orderBy("query_id").collect()]
    assert tasks == ["SINGLE_VQA", "SINGLE_CAPTION", "GROUNDING", "TEMPORAL_CHANGE", "OPTICAL_SAR"]


def test_large_gazetteer_gives_the_same_places(spark, gaz):
    df = texts(spark, "erode east and perundurai", "eroded soil", "Erode", "nothing", None, "Erode")
    filler = spark.range(3000).selectExpr("concat('nowhere', id) as key", "cast(1000 + id as int) as ord", *[f"cast(null as {t}) as {c}" for c, t in gaz.dtypes if c not in ("key", "ord")])
    for mode in ("word", "contains"):
        small = {r["query_id"]: r["place"] for r in gazetteer.match_places(df, gaz, mode=mode).collect()}
        large = {r["query_id"]: r["place"] for r in gazetteer.match_places(df, gaz.unionByName(filler.select(*gaz.columns)), mode=mode).collect()}
        assert small == large and len(small) == 6
        assert small[0]["key"] == "perundurai" and small[3] is None and small[4] is None and small[5] == small[2]
        assert (small[1] is None) == (mode == "word")


def test_built_in_places(spark):
    from scenelake.sources import gazetteer as source

    assert source.places(spark).count() == 6 and source.areas(spark).count() == 18
    row = gazetteer.geocode(texts(spark, "Show me Chennai Port today"), source.areas(spark), mode="contains").first()
    # The first entry that is named wins, and its own box is used.
    assert row["place_name"].startswith("Chennai Harbor") and (row["min_lon"], row["max_lat"]) == (80.18, 13.25)


def test_coordinates_in_text(spark, gaz):
    row = gazetteer.geocode(texts(spark, "land at 11.5, 77.25"), gaz).first()
    assert (row["lat"], row["lon"], row["resolved_by"], row["min_lon"]) == (11.5, 77.25, "coordinates", 77.21)


@pytest.mark.parametrize(
    ("coords", "size", "want"),
    [
        ([150.0, 200.0, 650.0, 750.0], (None, None), (15.0, 20.0, 65.0, 75.0)),
        ([0.12, 0.34, 0.56, 0.78], (None, None), (12.0, 34.0, 56.0, 78.0)),
        ([128.0, 64.0, 384.0, 256.0], (512, 512), (25.0, 12.5, 75.0, 50.0)),
        ([70.0, 80.0, 20.0, 10.0], (None, None), (20.0, 10.0, 70.0, 80.0)),
        ([512.0, 0.0, 1024.0, 2048.0], (None, None), (50.0, 0.0, 100.0, 100.0)),
    ],
)
def test_box_scales(spark, coords, size, want):
    df = spark.createDataFrame([(coords,)], "c array<double>")
    width, height = (F.lit(s) if s else None for s in size)
    assert tuple(df.select(bx.checked_box("c", width=width, height=height).alias("b")).first()["b"]) == want


def test_wrong_box_length_fails(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "c array<double>")
    with pytest.raises(Exception, match="expected 4 coordinate values, got 2"):
        df.select(bx.checked_box("c")).collect()


def test_boxes_in_text(spark):
    df = texts(
        spark,
        "The field is at [580, 220, 880, 720]. Another one at [200, 400, 580, 800].",
        "<p>some buildings</p> {<56><57><60><65>|<90>}<delim>{<57><49><61><57>|80}",
        "nothing here",
        "tiny [10, 10, 10.2, 10.3]",
    )
    got = box_text.extract_boxes(df).orderBy("query_id", "position").collect()
    sides = [(r["ymin"], r["xmin"], r["ymax"], r["xmax"]) for r in got]
    assert sides == [(58.0, 22.0, 88.0, 72.0), (20.0, 40.0, 58.0, 80.0), (56.0, 57.0, 60.0, 65.0), (57.0, 49.0, 61.0, 57.0)]
    assert [r["confidence"] for r in got] == [0.92, 0.92, 0.9, 0.8]
    assert got[2]["label"] == "Buildings" and got[3]["color"] == "#06b6d4"


def test_clean_output(spark):
    df = texts(spark, "There are <p>two ships</p> {<1><2><3><4>|<90>}<delim> near  the <box>[1]</box> dock .", None)
    assert [r[0] for r in df.select(tx.clean_output("text")).collect()] == ["There are two ships near the dock.", ""]


def test_merge_keeps_first_free_boxes(spark):
    cols = "image_id int, ord int, ymin double, xmin double, ymax double, xmax double, label string"
    anchors = spark.createDataFrame([(1, 0, 10.0, 10.0, 20.0, 20.0, "a")], cols)
    parsed = spark.createDataFrame(
        [(1, i, 10.0 + 4 * i, 10.0, 20.0, 20.0, "p") for i in range(1, 30)] + [(2, i, 1.0, 1.0, 2.0, 2.0, "q") for i in range(6)], cols
    )
    got = box_text.merge_boxes(anchors, parsed)
    assert sorted(r["ord"] for r in got.filter("image_id = 1").collect()) == list(range(0, 30, 2))
    capped = box_text.merge_boxes(anchors, parsed, cap=4)
    assert sorted(r["ord"] for r in capped.filter("image_id = 1").collect()) == [0, 2, 4, 6]
    assert got.filter("image_id = 2").count() == 6


def steps(spark):
    rows = [
        (1, 1, "COMPLETED", 0.9, 10, "vqa", "green", None),
        (1, 2, "COMPLETED", 0.7, 20, "spectral", "green", "WEIGHTS_NOT_FOUND"),
        (1, 3, "FAILED", 0.0, 5, "vqa", "gone", None),
        (2, 1, "COMPLETED", 0.0, 7, "vqa", "", None),
    ]
    return spark.createDataFrame(rows, "analysis_id int, step int, status string, confidence double, duration_ms bigint, tool string, text string, model_status string")


def test_folding(spark):
    analyses = spark.createDataFrame([(1,), (2,), (3,)], "analysis_id int")
    got = {r["analysis_id"]: r for r in hs.fold_all(analyses, steps(spark)).collect()}
    assert got[1]["confidence"] == pytest.approx(0.8) and got[1]["model_status"] == "WEIGHTS_NOT_FOUND"
    assert got[2]["confidence"] == 0.88 and got[2]["model_status"] == "READY"
    assert (got[3]["confidence"], got[3]["model_status"], got[3]["tools"]) == (0.0, "FAILED", 0)
    rolled = {r["analysis_id"]: r for r in hs.trace_rollup(steps(spark)).collect()}
    assert rolled[1]["models_used"] == ["vqa", "spectral"] and rolled[1]["answer"] == "green gone" and rolled[1]["duration_ms"] == 35


def test_history_errors(spark):
    with pytest.raises(KeyError):
        hs.get_analysis(steps(spark), 9)
    with pytest.raises(KeyError):
        hs.without_analysis(steps(spark), 9)
    assert hs.without_analysis(steps(spark), 1).count() == 1


def test_reports(spark):
    analyses = spark.createDataFrame(
        [(1, "Is it green?", "VQA", "DONE", 0.87, "Yes", ["m1", "m2"], 35, "2026-01-01")],
        "analysis_id int, query string, task string, status string, confidence double, answer string, models_used array<string>, execution_time_ms bigint, created_at string",
    )
    evidence = spark.createDataFrame([(1, "e1", "cat", "Title", 0.5, "seen")], "analysis_id int, evidence_id string, category string, title string, confidence double, description string")
    trace = spark.createDataFrame([(1, 2, "b", "", 5, ""), (1, 1, "a", "t", 4, "ok")], "analysis_id int, step int, name string, tool string, duration_ms bigint, output_summary string")
    text = hs.render_reports(analyses, evidence, trace, notes="checked").first()["content"]
    assert "| `e1` | cat | **Title** | 50% | seen |" in text and "87%" in text and text.index("| 1 | a | `t` | 4ms | ok |") < text.index("| 2 | b | `System` | 5ms | - |")
    assert "## 5. Analyst Annotations\nchecked" in text
    short = hs.render_reports(analyses, evidence, trace, include_evidence=False, include_trace=False).first()["content"]
    assert "Evidence" not in short and "Trace" not in short
    doc = json.loads(hs.render_reports(analyses, evidence, trace, fmt="json", include_trace=False).first()["content"])
    assert doc["evidence"][0]["title"] == "Title" and doc["execution_trace"] == [] and doc["analyst_notes"]


def test_places_in_long_texts(spark):
    """Both modes against a plain search, with keys of several words, edges and odd letters; long texts take seconds."""
    rng = random.Random(9)
    keys = ["new york", "york", "st. john's", "san josé", "são", "(old) town", "c++", "the a-b c", "new", "_x", "a", "ab", "—"]
    gaz = spark.createDataFrame([(k.lower(), i, k, 1.0, 2.0) for i, k in enumerate(keys)] + [("york", 1, "again", 3.0, 4.0)], "key string, ord int, name string, lat double, lon double")
    bits = [*keys, "yorker", "x", " ", "  ", ".", "-", "_", "\n", "é", "1", "old", "town", "san", "josé"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["", None, "c++", "c++x", "xc++", "(old) town", "new york"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for mode in ("word", "contains"):
        got = {r["i"]: r["place"] and r["place"]["key"] for r in gazetteer.match_places(df, gaz, mode=mode).collect()}
        for i, t in enumerate(texts):
            low = (t or "").lower()
            hit = [k for k in (k.lower() for k in keys) if (re.search(rf"(?<!\w){re.escape(k)}(?!\w)", low) and re.search(r"\w", k) if mode == "word" else k in low)]
            assert got[i] == (hit[0] if hit else None), (mode, t)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    long = spark.createDataFrame([(k, " ".join([*words[k:], "new york"])) for k in range(8)], "i int, text string")
    began = time.time()
    assert {r["place"]["key"] for r in gazetteer.match_places(long, gaz).collect()} == {"new york"}
    assert time.time() - began < 40
