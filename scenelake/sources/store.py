"""Append-only product store that keeps one row per product and box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators.catalog import cache_key


def with_key(products: DataFrame, bbox: Sequence[str] | None = None) -> DataFrame:
    return products.withColumn("key", cache_key("product_id", bbox))


def new_products(products: DataFrame, store: DataFrame | None, force_refresh: bool = False) -> DataFrame:
    """Keyed products not in the store yet, one per key (the smallest row, so reruns agree).

    The choice per key is an aggregation with map-side combine, not a sort.
    """
    fresh = products
    if store is not None and not force_refresh:
        fresh = products.join(store.select("key").distinct(), "key", "left_anti")
    rest = [c for c in fresh.columns if c != "key"]
    return fresh.groupBy("key").agg(F.min(F.struct(*rest)).alias("p")).select("key", "p.*")


def cached_products(products: DataFrame, store: DataFrame) -> DataFrame:
    """Keyed products the store already has."""
    return products.join(store.select("key").distinct(), "key", "left_semi")


def put_products(products: DataFrame, path: str, spark: SparkSession, force_refresh: bool = False) -> None:
    """Append the new products to the store folder, stamped with ``written_at``; a refresh appends all of them."""
    store = None
    if not force_refresh:
        try:
            store = spark.read.parquet(path)
        except Exception as error:  # the folder does not exist before the first write
            if "PATH_NOT_FOUND" not in str(error):
                raise
    fresh = new_products(products, store, force_refresh)
    fresh.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def clear_store(path: str, spark: SparkSession) -> None:
    """Empty the store; its columns stay."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def latest(store: DataFrame, version: str = "written_at") -> DataFrame:
    """The newest row of each key of a store that was also written with refreshes."""
    rest = [c for c in store.columns if c != "key"]
    newest = F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version]))
    return store.groupBy("key").agg(newest.alias("p")).select("key", "p.*")
