"""Land search: equal texts and far pixels cost little, own areas, missing values; many blocks in one call."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenelake.operators import candidates as cd
from scenelake.operators import components as cc
from scenelake.operators.blocks import map_many_groups
from scenelake.plans import land_search as ls


@pytest.fixture(scope="module")
def world(spark):
    """Two scenes of 4 x 4 cells of open water over two years, one at the place and one far away; one box of its own far away."""
    cells = spark.range(2 * 16 * 2).selectExpr("id div 32 as scene_id", "id % 16 div 4 as row", "id % 4 as col", "int(2021 + id % 32 div 16) as yr")
    px = cells.withColumns({"b03": F.lit(0.9), "b04": F.lit(0.2), "b08": F.lit(0.1), "b11": F.lit(0.1)})
    px = px.groupBy("scene_id", "row", "col", "yr").agg(*[F.max(b).alias(b) for b in ("b03", "b04", "b08", "b11")])
    headers = spark.createDataFrame(
        [(0, 0.01, 77.0, -0.01, 11.0, 4, 4, 4326), (1, 0.01, 87.0, -0.01, 21.0, 4, 4, 4326)],
        "scene_id long, a double, c double, e double, f double, width int, height int, epsg int",
    )
    gaz = spark.createDataFrame([("erode", 1, "Erode", 10.98, 77.02)], "key string, ord int, name string, lat double, lon double")
    water = "Show water bodies near Erode"
    rows = [(i, water) for i in range(30)] + [(30, None), (31, "Who is the owner of land in Erode?"), (32, "Show water in Nowhere"), (33, water), (33, water), (None, water)]
    return px, headers, spark.createDataFrame(rows, "query_id long, text string"), gaz


def test_equal_texts_are_parsed_once(spark, world, monkeypatch):
    px, headers, queries, gaz = world
    parse, cells, seen = ls.parse_land_queries, cd.persistent_cells, {}

    def counted(df, gaz):
        seen["texts"] = df.count()
        return parse(df, gaz)

    def planned(px, *rest):
        seen["plan"] = px._jdf.queryExecution().optimizedPlan().toString()
        return cells(px, *rest)

    monkeypatch.setattr(ls, "parse_land_queries", counted)
    monkeypatch.setattr(cd, "persistent_cells", planned)
    found = ls.land_search(px, headers, queries, gaz, "yr", 0.8)
    assert seen["texts"] == 4
    # scenes that no request meets are left out below the aggregation of the pixels
    assert seen["plan"].index("Aggregate") < seen["plan"].index("LeftSemi") and "rightHint=(strategy=broadcast)" in seen["plan"]
    assert found.requests.count() == queries.count() and found.requests.columns[:2] == ["query_id", "text"]
    got = [(r.query_id, r.scene_id, r.rank, r.pixels, r.temporal_persistence) for r in found.candidates.collect()]
    # equal requests of one query are two requests, as before
    want = Counter((i, 0, 1, 16, "32/32 observations") for i in [*range(30), 33, 33, None])
    assert Counter(got) == want
    status = Counter((r.query_id, r.status, r.candidates) for r in found.answers.collect())
    assert status[30, None, 0] + status[30, "UNKNOWN_LOCATION", 0] == 1
    assert status[31, "UNSUPPORTED_QUERY", 0] == status[32, "UNKNOWN_LOCATION", 0] == status[5, "COMPLETED", 1] == 1


def test_areas_stand_in_place_of_the_place(spark, world):
    px, headers, queries, gaz = world
    areas = spark.createDataFrame([(1, 86.9, 20.9, 87.1, 21.1), (2, None, None, None, None), (3, 0.0, 0.0, 1.0, 1.0), (4, 76.0, 10.0, 78.0, 12.0), (4, 86.9, 20.9, 87.1, 21.1)], "query_id long, x0 double, y0 double, x1 double, y1 double")
    found = ls.land_search(px, headers, queries.filter("query_id < 6"), gaz, "yr", 0.8, areas=areas)
    assert Counter((r.query_id, r.scene_id) for r in found.candidates.collect()) == Counter([(0, 0), (1, 1), (2, 0), (4, 0), (4, 1), (5, 0)])


def test_years_of_no_span_are_left_out_of_the_scan(spark, world, monkeypatch):
    px, headers, _, _ = world
    regions, seen = ls._regions, {}

    def planned(cells, *rest):
        seen["plan"] = cells._jdf.queryExecution().optimizedPlan().toString()
        return regions(cells, *rest)

    monkeypatch.setattr(ls, "_regions", planned)
    spans = spark.createDataFrame([(2021, 2022), (2021, 2024), (None, 2022)], "from_year int, to_year int")
    assert ls.change_region_table(px, headers, "yr", spans).count() == 0
    semi = seen["plan"].index("LeftSemi")
    assert seen["plan"][:semi].count("Aggregate") == 2 and "Aggregate" not in seen["plan"][semi:]


def test_many_groups_go_into_one_call(spark):
    """Groups are whole and numbered in order, whatever the batches are; nulls of a key are equal."""
    df = spark.range(30_000).selectExpr("if(id % 300 = 7, null, id % 300) as k", "id as x").coalesce(1)

    def fold(table, group):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        assert np.array_equal(group[first], np.arange(len(first)))
        return pa.table({"k": table["k"].take(pa.array(first)), "n": np.add.reduceat(np.ones(len(group), int), first), "calls": np.full(len(first), len(first))})

    got = map_many_groups(df, ["k"], fold, "k long, n long, calls long").collect()
    assert Counter((r.k, r.n) for r in got) == Counter({(k if k != 7 else None, 100): 1 for k in range(300)})
    assert max(r.calls for r in got) > 5


def test_runs_of_many_scenes_by_block(spark):
    """Blocks that follow each other in one call do not touch, and pixels without a place lie in no run."""
    rng = np.random.default_rng(11)
    masks = {s: rng.random((9, 11)) < 0.55 for s in range(40)}
    rows = [(s, r - 4, c - 4, 1) for s, m in masks.items() for r, c in zip(*map(lambda x: x.tolist(), np.nonzero(m)))]
    cells = spark.createDataFrame(rows + [(1, None, 3, 1), (2, 3, None, 1), (3, None, None, 1)], "scene_id int, row int, col int, mask int")
    for block in (4, 256):
        got = cc.components(cells, block=block).collect()
        assert Counter((r.scene_id, r.row, r.col, 1) for r in got) == Counter(rows)
        label = {(r.scene_id, r.row, r.col): r.label for r in got}
        for s, r, c, _ in rows:
            for other in ((s, r + 1, c), (s, r, c + 1)):
                assert label.get(other, label[s, r, c]) == label[s, r, c]
        # every label is the number of one of its own pixels, so parts that do not touch have different ones
        assert all(label.get((s, (v + 2**31) >> 32, ((v + 2**31) & 0xFFFFFFFF) - 2**31)) == v for (s, _, _), v in label.items())


def test_searches_of_one_request_are_copied_few_times(spark, monkeypatch):
    shared = spark.range(100).select(F.lit("s").alias("spec"), "id")
    searches = spark.range(1000).select(F.col("id").alias("query_id"), F.lit("s").alias("spec"))
    deal, sizes = cd.spread, []
    monkeypatch.setattr(cd, "spread", lambda df, *keys: sizes.append(df.count()) or deal(df, *keys))
    out = cd.hand_out(shared, searches, "spec")
    assert sorted(sizes) == [400, 4000]
    assert out.count() == out.distinct().count() == 100_000
