"""Tables on disk: pixel tables by bucket, read back and joined."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as v
from checks.views import sql
from scenelake.operators.change import pair_pixels
from scenelake.operators.fusion import pair_modalities
from scenelake.session import ensure_checkpoint_dir
from scenelake.sources.pixels import BLOCK_KEYS, join_by_bucket, write_pixel_buckets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def saved(spark, px, block=8):
    """The pixels as a bucketed table of a name of its own."""
    name = f"px_{uuid.uuid4().hex}"
    write_pixel_buckets(px, name, f"{ensure_checkpoint_dir(spark)}/{name}", 8, block)
    return spark.table(name)


def _pairs(spark, sf):
    join_by_bucket(spark)
    obs = v.px_obs(spark, sf)
    sides = [saved(spark, obs.filter(F.col("ep") == k)) for k in (1, 2)]
    return pair_pixels(*sides, ("r", "g", "b"), BLOCK_KEYS).drop("block_row", "block_col")


QUERIES["j1_pixel_pairs_bucketed"] = _pairs
SQL["j1_pixel_pairs_bucketed"] = sql("px_pair", "select * from px_pair")


def _modalities(spark, sf):
    join_by_bucket(spark)
    optical = v.px_multi(spark, sf).select("scene_id", "row", "col", F.col("b04").alias("r"), F.col("b03").alias("g"), F.col("b02").alias("b"))
    return pair_modalities(saved(spark, optical), saved(spark, v.px_sar(spark, sf)), BLOCK_KEYS).drop("block_row", "block_col")


QUERIES["j2_modality_pairs_bucketed"] = _modalities
SQL["j2_modality_pairs_bucketed"] = sql(
    "px_multi px_sar",
    "select o.scene_id, o.row, o.col, b04 as r, b03 as g, b02 as b, vv, vh from px_multi o join px_sar s on o.scene_id = s.scene_id and o.row = s.row and o.col = s.col",
)
