"""Index product: index per pixel, statistics and classes per scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import indices as ix
from scenelake.operators.stats import index_stats


def index_product(px: DataFrame, index: str = "ndvi", keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Statistics and class percentages of one index per scene."""
    return index_stats(px, (index,), keys)


def index_layer(px: DataFrame, index: str = "ndvi", keys: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """Per-pixel index with its class and colour-ramp step."""
    value = px.select(*keys, ix.index_column(index).alias("value"))
    ramp = value.withColumn("class", ix.index_class(index, "value")).withColumn("ramp", ix.ramp_class(index, "value"))
    return ramp.select(*keys, "value", "class", F.col("ramp.legend").alias("legend"), "ramp.r", "ramp.g", "ramp.b")
