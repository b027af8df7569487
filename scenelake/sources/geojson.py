"""GeoJSON features as text rows and text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 5


def ring_coordinates(ring: str | Column, digits: int = DIGITS) -> Column:
    """ARRAY<ARRAY<DOUBLE>> of a ring, rounded."""
    c = F.col(ring) if isinstance(ring, str) else ring
    return F.transform(c, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))


def feature(ring: str | Column, properties: Sequence[str], digits: int = DIGITS) -> Column:
    """GeoJSON polygon feature text of a closed ring with columns as properties."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring_coordinates(ring, digits)).alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return F.to_json(body)


def write_features(df: DataFrame, path: str, ring: str, properties: Sequence[str]) -> None:
    """One feature per line, written in parallel."""
    df.select(feature(ring, properties).alias("value")).write.text(path)
