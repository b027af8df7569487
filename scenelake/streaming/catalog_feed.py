"""Catalog files as a stream into the product store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scenelake.sources.stac import STAC_SCHEMA, stac_rows
from scenelake.sources.store import put_products, with_key

def read_feed(spark: SparkSession, path: str, collection: str = "SENTINEL-2", files_per_batch: int = 100) -> DataFrame:
    """Scenes of the feature-collection files that arrive under a path."""
    files = (
        spark.readStream.schema(STAC_SCHEMA)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return stac_rows(files, collection)


def start_feed(scenes: DataFrame, store_path: str, checkpoint_path: str, available_now: bool = False) -> StreamingQuery:
    """Append the scenes that the store does not have yet, whenever they were acquired.

    Each batch is anti-joined with the stored keys, so a batch that is run again adds nothing, an old scene that
    arrives late is kept, and no state grows with the stream.
    """

    def put(batch: DataFrame, _: int) -> None:
        put_products(with_key(batch), store_path, batch.sparkSession)

    writer = scenes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
