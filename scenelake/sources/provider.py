"""Scene providers: catalog folders read by the STAC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators.catalog import filter_scenes
from scenelake.sources.stac import read_stac


class FolderProvider:
    """Scenes from a folder of STAC files and pixels from a table partitioned by product."""

    def __init__(self, catalog_path: str, pixel_path: str | None = None, collection: str = "SENTINEL-2") -> None:
        self.catalog_path, self.pixel_path, self.collection = catalog_path, pixel_path, collection

    def search(self, spark: SparkSession, **filters) -> DataFrame:
        return filter_scenes(read_stac(spark, self.catalog_path, self.collection), **filters)

    def get_product(self, spark: SparkSession, product_id: str) -> DataFrame:
        return read_stac(spark, self.catalog_path, self.collection).filter(F.col("product_id") == product_id)

    def pixels(self, spark: SparkSession, product_ids: DataFrame) -> DataFrame:
        if self.pixel_path is None:
            raise ValueError("this provider has no pixel table")
        return spark.read.parquet(self.pixel_path).join(product_ids.select("product_id"), "product_id", "left_semi")
