"""Bucketed pixel tables: joins without an exchange, one file a bucket, a large scene over many buckets."""

import uuid

import pytest
from pyspark.sql import functions as F

from scenelake.operators.change import pair_pixels
from scenelake.operators.fusion import pair_modalities
from scenelake.sources.pixels import BLOCK_KEYS, join_by_bucket, write_pixel_buckets


@pytest.fixture
def cells(spark):
    return spark.range(4096).selectExpr("cast(if(id < 4000, 1, id) as int) as scene_id", "cast(id div 64 as int) as row", "cast(id % 64 as int) as col")


def test_pixel_joins_have_no_exchange(spark, cells, tmp_path):
    join_by_bucket(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
        optical = cells.selectExpr("*", "row as r", "col as g", "1 as b", "0.5D as vv", "0.1D as vh")
        for name, px in zip(names, (optical, optical.filter("col <> 5"))):
            write_pixel_buckets(px, name, str(tmp_path / name), 8, 8)
        before, after = (spark.table(n) for n in names)
        for joined in (pair_pixels(before, after, ("r", "g", "b"), BLOCK_KEYS), pair_modalities(before, after, BLOCK_KEYS)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert joined.count() == 4096 - 64
        # aggregations by scene start from the join's rows without moving pixels first
        files = before.filter("scene_id = 1").select(F.input_file_name().alias("f")).distinct().count()
        assert files == 8 and len(list((tmp_path / names[0]).glob("*.parquet"))) == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in names:
            spark.sql(f"drop table if exists {name}")
