"""Work shared by equal requests, and groups that must not be merged into one task."""

import pyarrow as pa
from pyspark.sql import functions as F

from scenelake.operators import candidates as cd
from scenelake.operators.blocks import map_groups
from scenelake.plans import retrieval_answers as ra

CAND = "spec string, cand_id string, area_hectares double, distance_km double, persistence_ratio double, name string"


def test_equal_searches_are_refined_once(spark):
    shared = spark.createDataFrame([(s, f"{s}{i}", 10.0 * i, 5.0 - i, 0.5 + i / 10, "n") for s in "ab" for i in range(5)], CAND)
    asked = [(1, "a"), (2, "a"), (3, "b"), (4, "a"), (4, "b"), (5, "a"), (5, "a"), (None, "a")]
    said = [(1, "nearest"), (2, "nearest"), (3, "larger than 15 ha"), (4, "closest"), (5, None), (5, "persistent"), (6, "closest"), (None, "closest")]
    searches, prompts = spark.createDataFrame(asked, "search_id int, spec string"), spark.createDataFrame(said, "search_id int, prompt string")
    grouped = cd.shared_searches(searches, prompts)
    assert grouped.select("group").distinct().count() == 4 and grouped.count() == 5
    told = cd.hand_out(cd.refine_shared(shared, grouped), grouped.select("search_id", "group"), "group")
    plain = cd.refine_candidates(searches.join(shared, "spec").drop("spec"), prompts)
    columns = ["search_id", "cand_id", "rule", "position"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    # rows of one search that differ by their rule alone may trade places
    assert [r for r in rows(told) if r[0] != 5] == [r for r in rows(plain) if r[0] != 5]
    assert sorted((r[0], r[1], r[2]) for r in rows(told)) == sorted((r[0], r[1], r[2]) for r in rows(plain))


def test_rows_of_one_request_are_handed_out_by_many_tasks(spark):
    shared = spark.range(2000).select(F.lit("s").alias("spec"), "id")
    searches = spark.range(50).select(F.col("id").alias("query_id"), F.lit("s").alias("spec"))
    out = cd.hand_out(shared, searches, "spec")
    assert out.count() == 100_000 and out.columns == ["query_id", "id"]
    assert out.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() > 2


def test_persistence_keeps_its_partitions(spark):
    px = spark.range(4000).selectExpr("id % 400 as scene_id", "id % 20 as row", "id % 5 as col", "id div 400 as yr", "id % 3 = 0 as bare")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (cd.persistence(px, F.col("bare"), "yr"), cd.persistent_cells(px, {"bare": F.col("bare")}, "yr", 0.0)):
        assert out.count() == 400 and out.rdd.getNumPartitions() == parts


def test_groups_of_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "k int, x long")
    out = map_groups(df.coalesce(1), ["k"], lambda t: pa.table({"k": t["k"].slice(0, 1), "x": pa.array([sum(t["x"].to_pylist())])}), "k int, x long")
    assert sorted(out.collect(), key=str) == sorted([(None, 3), (1, 3), (2, 4)], key=str)


def test_pixels_of_products_without_a_job_are_not_shuffled(spark):
    """A short list of products is broadcast to the scan of the pixels, before the join by block."""
    products = spark.createDataFrame([(f"p{i}",) for i in range(50)], "product_id string")
    px = products.repartition("product_id").select("product_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("r"))
    fields = "job string, branch string, part string, product_id string, block_row int, block_col int, x0 double, y0 double, x1 double, y1 double, a double, c double, e double, f double, row0 int, row1 int, col0 int, col1 int"
    blocks = spark.createDataFrame([("j", "optical", "first", "p3", 0, 0, 0.0, -8.0, 1.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0, 8, 0, 1)], fields).repartition(2)
    met = ra.box_pixels(px, blocks)
    assert met.count() == 8
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    semi = next(line for line in plan.splitlines() if "LeftSemi" in line)
    assert "rightHint=(strategy=broadcast)" in semi and plan.index("Join Inner") < plan.index("LeftSemi") < plan.index("Generate")
