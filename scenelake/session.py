"""Session helpers: a local session for tests and benches, and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "scenelake", cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster job brings its own session."""
    partitions = "8" if cores == "*" else str(cores)
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    folder must be one that every executor shares.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="scenelake-ckpt-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Shuffle by keys into the session's number of shuffle partitions.

    For steps that cost much more per byte than a scan (window passes, Python groups): the
    fixed number keeps small inputs from being merged into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a table that ``small`` broadcasts at most.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has few rows; it is counted, so it should be a written one (``cut_lineage``)."""
    return F.broadcast(df) if df.count() <= rows else df
