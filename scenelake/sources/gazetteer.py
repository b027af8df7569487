"""Place tables for geocoding: built-in places, or a table of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Places with centre and box (min_lon, min_lat, max_lon, max_lat).
PLACES = [
    ("perundurai", "Perundurai, Erode District, Tamil Nadu, India", 11.2750, 77.5833, (77.5300, 11.2300, 77.6350, 11.3200)),
    ("erode", "Erode, Tamil Nadu, India", 11.3410, 77.7172, (77.6600, 11.2900, 77.7700, 11.3900)),
    ("coimbatore", "Coimbatore, Tamil Nadu, India", 11.0168, 76.9558, (76.8800, 10.9500, 77.0400, 11.0800)),
    ("chennai", "Chennai, Tamil Nadu, India", 13.0827, 80.2707, (80.1800, 13.0000, 80.3500, 13.2500)),
    ("mumbai", "Mumbai, Maharashtra, India", 19.0760, 72.8777, (72.7500, 18.8800, 73.0500, 19.2500)),
    ("bengaluru", "Bengaluru, Karnataka, India", 12.9716, 77.5946, (77.5000, 12.8500, 77.7500, 13.1000)),
]

# Retrieval areas with box and usual sensor.
AREAS = [
    ("chennai", "Chennai Harbor & Estuary, Tamil Nadu, India", (80.18, 13.00, 80.35, 13.25), "Sentinel-2 MSI"),
    ("chennai port", "Chennai Port Marine Logistics Terminal", (80.25, 13.05, 80.34, 13.14), "Sentinel-2 MSI"),
    ("ennore", "Ennore Port & Tidal Creek Basin, Tamil Nadu", (80.30, 13.20, 80.38, 13.32), "Sentinel-2 MSI"),
    ("mumbai", "Mumbai Metropolitan Region & Jawaharlal Nehru Port, Maharashtra", (72.75, 18.88, 73.05, 19.25), "Sentinel-2 MSI"),
    ("kochi", "Kochi Backwaters & International Container Port, Kerala", (76.20, 9.90, 76.35, 10.05), "Sentinel-1 SAR C-Band"),
    ("visakhapatnam", "Visakhapatnam Deepwater Harbor & Steel Basin, Andhra Pradesh", (83.25, 17.65, 83.38, 17.75), "Sentinel-2 MSI"),
    ("port blair", "Port Blair Coastal Lagoon, Andaman and Nicobar Islands", (92.70, 11.60, 92.80, 11.72), "Sentinel-2 MSI"),
    ("bengaluru", "Bengaluru Urban Watersheds & Bellandur Lake, Karnataka", (77.50, 12.85, 77.75, 13.10), "Sentinel-2 MSI"),
    ("new delhi", "National Capital Region (NCR) & Yamuna Floodplain", (77.05, 28.50, 77.35, 28.75), "Sentinel-2 MSI"),
    ("suez canal", "Suez Canal Maritime Transit Corridor, Egypt", (32.25, 30.40, 32.65, 31.25), "Sentinel-1 SAR C-Band"),
    ("perundurai", "Perundurai, Erode District, Tamil Nadu, India", (77.5300, 11.2300, 77.6350, 11.3200), "Sentinel-2 MSI"),
    ("erode", "Erode, Tamil Nadu, India", (77.6600, 11.2900, 77.7700, 11.3900), "Sentinel-2 MSI"),
    ("coimbatore", "Coimbatore, Tamil Nadu, India", (76.8800, 10.9500, 77.0400, 11.0800), "Sentinel-2 MSI"),
    ("salem", "Salem, Tamil Nadu, India", (78.1000, 11.6000, 78.2200, 11.7200), "Sentinel-2 MSI"),
    ("madurai", "Madurai, Tamil Nadu, India", (78.0800, 9.8800, 78.1800, 9.9800), "Sentinel-2 MSI"),
    ("hyderabad", "Hyderabad, Telangana, India", (78.3500, 17.3000, 78.5500, 17.5000), "Sentinel-2 MSI"),
    ("kolkata", "Kolkata, West Bengal, India", (88.2500, 22.4500, 88.4500, 22.6500), "Sentinel-2 MSI"),
    ("san francisco", "San Francisco Bay & Port of Oakland, USA", (-122.52, 37.70, -122.20, 37.88), "Sentinel-2 MSI"),
]

SCHEMA = (
    "key STRING, ord INT, name STRING, lat DOUBLE, lon DOUBLE, min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, "
    "max_lat DOUBLE, default_sensor STRING"
)


def places(spark: SparkSession) -> DataFrame:
    """Built-in places of the land search."""
    rows = [(key, i, name, lat, lon, *box, None) for i, (key, name, lat, lon, box) in enumerate(PLACES)]
    return spark.createDataFrame(rows, SCHEMA)


def areas(spark: SparkSession) -> DataFrame:
    """Built-in areas of the scene retrieval; the centre is the middle of the box."""
    rows = [
        (key, i, name, (box[1] + box[3]) / 2.0, (box[0] + box[2]) / 2.0, *box, sensor)
        for i, (key, name, box, sensor) in enumerate(AREAS)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Places from a table with at least key, name, lat, lon; without ``ord`` all rank equal and keys decide."""
    table = spark.read.parquet(path)
    keyed = table.withColumn("key", F.lower(F.trim("key")))
    return keyed if "ord" in table.columns else keyed.withColumn("ord", F.lit(0))
