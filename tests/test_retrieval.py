"""Retrieval answers: branches, shared jobs, box windows, blocks read from a partitioned pixel table."""

import pytest
from pyspark.sql import functions as F

from scenelake.plans import retrieval_answers as ra
from scenelake.sources.pixels import read_pixel_blocks, write_pixel_blocks

PAIRS = (
    "query_id int, task string, before_product_id string, before_weighed long, after_product_id string, after_weighed long, "
    "partner_product_id string, partner_weighed long, x0 double, y0 double, x1 double, y1 double"
)
CHANGE, RADAR, ONE = "Bi-Temporal Change Analysis", "SAR Radar Analysis", "Single Optical Analysis"
BOX = (0.0, -4.0, 4.0, 0.0)


@pytest.fixture(scope="module")
def world(spark):
    """Two optical scenes and a radar one on the same 8 x 8 cells, one optical scene moved by two columns."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    rows = [("o1", r, c, 30, 200, 30, None, None) for r, c in cells] + [("o2", r, c, 220, 30, 30, None, None) for r, c in cells]
    rows += [("o3", r, c, 30, 200 if c != 1 else 30, 30, None, None) for r, c in cells]
    rows += [("s1", r, c, None, None, None, -1.0 if c < 2 else -25.0, None) for r, c in cells]
    px = spark.createDataFrame(rows, "product_id string, row int, col int, r int, g int, b int, vv double, vh double")
    heads = [(p, 1.0, 2.0 if p == "o3" else 0.0, -1.0, 0.0, 8, 8) for p in ("o1", "o2", "o3", "s1")]
    return px, spark.createDataFrame(heads, "product_id string, a double, c double, e double, f double, width int, height int")


def test_branches_and_statuses(spark, world):
    rows = [
        (1, CHANGE, "o1", 3, "o2", 2, None, None, *BOX),
        (2, CHANGE, "o1", 3, "o2", 2, None, None, *BOX),
        (3, CHANGE, "o1", 3, None, None, None, None, *BOX),
        (4, RADAR, "s1", 1, None, None, "o1", 5, *BOX),
        (5, RADAR, "s1", 1, None, None, None, None, *BOX),
        (6, ONE, "o3", 1, None, None, None, None, *BOX),
        (7, ONE, "o1", 1, None, None, None, None, 50.0, 50.0, 51.0, 51.0),
        (8, ONE, None, None, "o1", 1, None, None, *BOX),
        (9, CHANGE, "o1", 1, "o3", 1, None, None, *BOX),
    ]
    found = ra.answer_requests(spark.createDataFrame(rows, PAIRS), *world)
    got = {r["query_id"]: r for r in found.answers.collect()}
    assert [(got[i]["branch"], got[i]["status"], got[i]["pixels"]) for i in range(1, 10)] == [
        ("change", "COMPLETED", 16), ("change", "COMPLETED", 16), (None, "NO_SCENE", None), ("fusion", "COMPLETED", 16), ("radar", "COMPLETED", 16),
        ("optical", "COMPLETED", 8), ("optical", "NO_PIXELS", None), (None, "NO_SCENE", None), ("change", "COMPLETED", 8),
    ]
    assert found.change.count() == 2 and got[1]["value"] == got[2]["value"] == 100.0
    # o3 begins two columns further right: the cells of the pair are those of the ground, not of the files
    assert got[6]["value"] == 50.0 and got[9]["value"] == 50.0
    # cells of the radar scene: two columns bounce, two are smooth
    assert found.fusion.first()["s_double_bounce"] == 8 and found.fusion.first()["s_specular_water"] == 8
    assert {r["source"] for r in found.evidence.collect()} == {"sar", "combined", "optical"}
    steps = found.trace.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("bad")).collect()
    assert {r["query_id"]: (r["n"], r["bad"]) for r in steps} == {i: (5, {3: 2, 7: 2, 8: 3}.get(i, 0)) for i in range(1, 10)}
    assert found.trace.filter("query_id = 4 and step = 2").first()["text"] == "1 scenes for the first date, 0 for the second, 5 partners."


def test_no_requests(spark, world):
    found = ra.answer_requests(spark.createDataFrame([], PAIRS), *world)
    assert found.answers.count() == 0 and found.trace.count() == 0 and found.single.count() == 0


def test_only_listed_folders_are_read(spark, world, tmp_path):
    """The list of blocks prunes the folders of the pixel table while the job runs."""
    px, headers = world
    many = px.filter("product_id = 'o1'").drop("product_id").crossJoin(spark.range(40).select(F.concat(F.lit("p"), "id").alias("product_id"))).unionByName(px)
    path = str(tmp_path / "px")
    write_pixel_blocks(many, path, parts=16, block=4)
    table = read_pixel_blocks(spark, path, parts=16)
    jobs = ra.plan_jobs(spark.createDataFrame([(1, ONE, "o1", 1, None, None, None, None, *BOX)], PAIRS))
    # a list that comes out of a file, as in a real job, cannot be folded into the plan beforehand
    ra.job_blocks(jobs, headers, 4).write.parquet(str(tmp_path / "blocks"))
    met = ra.box_pixels(table, spark.read.parquet(str(tmp_path / "blocks")), 4)
    own = spark.range(1).select(F.lit("o1").alias("product_id")).select(ra.product_part(spark, table)).first()[0]
    beside = [f for f in tmp_path.glob("px/product_part=*/*.parquet") if f.parent.name != f"product_part={own}"]
    assert len(beside) > 8
    for file in beside:
        file.write_bytes(b"no parquet")
    assert met.count() == 16
