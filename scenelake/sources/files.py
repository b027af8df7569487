"""Audit of raster files by name, size and signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.text import size_text

# Accepted extensions and file signatures (hex).
EXTENSIONS = ["tif", "tiff", "png", "jpg", "jpeg"]
SIGNATURES = {"tif": ["49492A00", "4D4D002A", "49492B00", "4D4D002B"], "png": ["89504E47"], "jpg": ["FFD8FF"]}


def file_extension(path: str | Column) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))


def file_guess(name: Column) -> Column:
    """STRUCT<modality, sensor, bands> guessed from a file name."""
    n = F.lower(name)
    s1 = n.rlike(r"\b(s1|sentinel[-_]?1)\b|sentinel-?1")
    s2 = n.rlike(r"\b(s2|sentinel[-_]?2)\b|sentinel-?2")
    risat = n.contains("risat")

    def guess(modality: str, sensor: Column | str, bands: int) -> Column:
        s = F.lit(sensor) if isinstance(sensor, str) else sensor
        return F.struct(F.lit(modality).alias("modality"), s.alias("sensor"), F.lit(bands).alias("bands"))

    plain = F.when(n.rlike(r"\.(png|jpe?g)$"), "Generic Benchmark").otherwise("Unknown Sensor")
    return (
        F.when(s1 | risat | n.contains("sar") | n.contains("radar"), guess("SAR", F.when(~s1 & risat, "RISAT-1A").otherwise("Sentinel-1"), 2))
        .when(s2 | n.contains("multispectral"), guess("Multispectral", "Sentinel-2", 12))
        .when(n.contains("cartosat"), guess("Optical", "Cartosat-2S", 4))
        .when(n.contains("change") | n.contains("temporal"), guess("Bi-Temporal Pair", "Sentinel-2", 4))
        .otherwise(guess("Optical", plain, 3))
    )


def audit_rows(files: DataFrame, signature: bool = False, require_crs: bool = False) -> DataFrame:
    """Status, size text and guesses for the rows of a listing, empty files included.

    ``files``: path, length; with ``signature`` content (the first bytes are enough). Where the listing has been read
    further, ``error`` (why a file could not be read), ``width``, ``height``, ``bands`` and ``epsg`` count too. The first
    status that applies: UNSUPPORTED_FORMAT, CORRUPTED_FILE, READ_ERROR, INVALID (no pixels, no bands, or no system of
    coordinates where ``require_crs``), VALID.
    """
    ext = file_extension("path")
    name = F.substring_index("path", "/", -1)
    supported = ext.isin(*EXTENSIONS)
    if signature:
        head = F.hex(F.substring("content", 1, 4))
        family = F.when(ext.isin("tif", "tiff"), "tif").when(ext == "png", "png").otherwise("jpg")
        good = F.lit(False)
        for kind, marks in SIGNATURES.items():
            for mark in marks:
                good = good | ((family == kind) & head.startswith(mark))
        broken = (F.col("length") == 0) | ~good
    else:
        broken = F.col("length") == 0
    status = F.when(~supported, "UNSUPPORTED_FORMAT").when(broken, "CORRUPTED_FILE")
    if "error" in files.columns:
        status = status.when(F.col("error").isNotNull(), "READ_ERROR")
    for side in ("width", "height", "bands"):
        if side in files.columns:
            status = status.when(F.coalesce(F.col(side), F.lit(0)) <= 0, "INVALID")
    if require_crs:
        status = status.when(F.col("epsg").isNull(), "INVALID")
    status = status.otherwise("VALID")
    return files.select(
        "path",
        name.alias("filename"),
        ext.alias("extension"),
        "length",
        size_text(F.col("length")).alias("size_text"),
        status.alias("status"),
        (status == "VALID").alias("is_valid"),
        file_guess(name).alias("guess"),
    ).select("*", "guess.*").drop("guess")


def audit_files(spark: SparkSession, path: str, signature: bool = False) -> DataFrame:
    """Audit all files under a path.

    Without ``signature`` only names and sizes are listed; with it file contents are read.
    Spark's file sources leave out files of length zero: give ``audit_rows`` a listing table to see those.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return audit_rows(files.select("path", "length", *(["content"] if signature else [])), signature)


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """The most recently modified file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified"))
