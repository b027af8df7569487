"""Band scan over pixel tables and the table layout they are written in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL_KEYS = ("scene_id", "row", "col")


def scan_bands(
    spark: SparkSession,
    path: str,
    bands: Sequence[str] | None = None,
    fill: float | None = None,
    keys: Sequence[str] = PIXEL_KEYS,
) -> DataFrame:
    """Read chosen bands of a wide pixel table; only their columns are read from the files.

    Bands the table does not have are left out; ValueError when none is left.
    """
    px = spark.read.parquet(path)
    present = [b for b in (bands if bands is not None else px.columns) if b in px.columns and b not in keys]
    if not present:
        raise ValueError(f"none of the bands {bands!r} is in {path}")
    columns = [F.coalesce(F.col(b), F.lit(fill)).alias(b) if fill is not None else F.col(b) for b in present]
    return px.select(*keys, *columns)


def nodata_to_null(px: DataFrame, bands: Sequence[str], nodata: float | None = None) -> DataFrame:
    """Turn NaN and the file's nodata number into NULL at load time."""
    changed = {}
    for band in bands:
        value = F.nanvl(F.col(band).cast("double"), F.lit(None).cast("double"))
        changed[band] = F.nullif(value, F.lit(float(nodata))) if nodata is not None else value
    return px.withColumns(changed)


def write_pixels(px: DataFrame, path: str, partition_by: Sequence[str] = ("collection", "month"), block: int = 256) -> None:
    """Write pixels so that file statistics prune scene and area reads.

    Rows are range-partitioned and sorted by scene and block, so one scene that holds most
    pixels is spread over many files.
    """
    row_block, col_block = (F.floor(F.col(c) / block).cast("int") for c in ("row", "col"))
    laid = px.withColumn("_rb", row_block).withColumn("_cb", col_block)
    order = [*partition_by, "scene_id", "_rb", "_cb"]
    laid.repartitionByRange(*order).sortWithinPartitions(*order).drop("_rb", "_cb").write.partitionBy(*partition_by).parquet(path)


def write_pixel_blocks(px: DataFrame, path: str, parts: int = 64, block: int = 256, key: str = "product_id") -> None:
    """Write pixels in folders by a hash of their product, sorted by product and block.

    A join with a list of (product, block) rows then reads only the folders of the listed products, found while the
    job runs, and skips by file statistics what lies beside the blocks.
    """
    laid = px.withColumns(
        {
            "block_row": F.floor(F.col("row") / block).cast("int"),
            "block_col": F.floor(F.col("col") / block).cast("int"),
            "product_part": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"),
        }
    )
    order = ["product_part", key, "block_row", "block_col"]
    laid.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("product_part").option("parquet.block.size", 32 << 20).parquet(path)


def read_pixel_blocks(spark: SparkSession, path: str, parts: int = 64) -> DataFrame:
    """A table of ``write_pixel_blocks``; ``parts`` must be the number it was written with."""
    part = F.col("product_part").cast("int").alias("product_part", metadata={"parts": parts})
    px = spark.read.parquet(path)
    return px.select(*[part if c == "product_part" else F.col(c) for c in px.columns])


#: Keys of a pixel join between bucketed tables.
BLOCK_KEYS = ("scene_id", "block_row", "block_col", "row", "col")


def write_pixel_buckets(px: DataFrame, table: str, path: str, buckets: int = 64, block: int = 256) -> None:
    """Save pixels as a table bucketed by scene and block, sorted by cell, one file a bucket.

    Blocks of one scene lie in different buckets, so a scene with most of the pixels is spread. Two dates, or two
    sensors, written with the same numbers meet in ``pair_pixels`` and ``pair_modalities`` on ``BLOCK_KEYS`` without a
    shuffle once ``join_by_bucket`` has been called for the session.
    """
    blocks = {"block_row": F.floor(F.col("row") / block).cast("int"), "block_col": F.floor(F.col("col") / block).cast("int")}
    keys = BLOCK_KEYS[:3]
    laid = px.withColumns(blocks).repartition(buckets, *keys)
    laid.write.bucketBy(buckets, *keys).sortBy(*BLOCK_KEYS).option("path", path).format("parquet").saveAsTable(table)


def join_by_bucket(spark: SparkSession) -> None:
    """Let the session join on more columns than a table is bucketed by without a new shuffle, and keep AQE from giving the buckets up."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
