"""Scene catalogs from STAC item files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAC_SCHEMA = """
features ARRAY<STRUCT<
  id: STRING,
  bbox: ARRAY<DOUBLE>,
  properties: STRUCT<
    id: STRING, datetime: STRING, start_datetime: STRING, `eo:cloud_cover`: DOUBLE, cloudCoverage: DOUBLE,
    `grid:code`: STRING, mgrs: STRING, platform: STRING>>>
"""

# Defaults and bands per collection.
DEFAULT_TILE = "T44N"
DEFAULT_PLATFORM = "Sentinel-2B"
COLLECTION_BANDS = {"SENTINEL-2": ["B02", "B03", "B04", "B08", "B11", "B12"], "SENTINEL-1": ["VV", "VH"]}


def stac_rows(features: DataFrame, collection: str, default_date: str | None = None, default_bbox=None) -> DataFrame:
    """Scene rows of feature collections; missing fields take the next best one or a default."""
    item = features.select(F.explode("features").alias("f")).select("f.*")
    prop = F.col("properties")
    cloud = F.coalesce(F.nullif(prop["eo:cloud_cover"], F.lit(0.0)), prop["cloudCoverage"], F.lit(0.0))
    box = F.col("bbox")
    if default_bbox is not None:
        box = F.coalesce(box, F.array(*[F.lit(float(v)) for v in default_bbox]))

    def corner(i: int) -> Column:
        return F.get(box, F.lit(i))

    date = F.coalesce(prop["datetime"], prop["start_datetime"], F.lit(default_date).cast("string"))
    return item.select(
        F.coalesce("id", prop["id"]).alias("product_id"),
        # UTC wall clock, whatever the session's time zone
        F.to_utc_timestamp(F.try_to_timestamp(date), F.current_timezone()).cast("timestamp_ntz").alias("acquired_at"),
        F.lit(collection).alias("collection"),
        F.round(cloud, 1).alias("cloud"),
        F.coalesce(prop["platform"], F.lit(DEFAULT_PLATFORM)).alias("platform"),
        F.coalesce(prop["grid:code"], prop["mgrs"], F.lit(DEFAULT_TILE)).alias("tile_id"),
        corner(0).alias("x0"),
        corner(1).alias("y0"),
        corner(2).alias("x1"),
        corner(3).alias("y1"),
        F.array(*[F.lit(b) for b in COLLECTION_BANDS.get(collection, [])]).cast("ARRAY<STRING>").alias("bands"),
        F.lit(10.0).alias("resolution_m"),
    )


def read_stac(spark: SparkSession, path: str, collection: str = "SENTINEL-2", default_date: str | None = None, default_bbox=None) -> DataFrame:
    """Scenes of all feature-collection files under a path; files are the unit of parallelism."""
    files = spark.read.schema(STAC_SCHEMA).option("multiLine", True).json(path)
    return stac_rows(files, collection, default_date, default_bbox)
