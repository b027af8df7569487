"""Full rankings inside groups of any size, and top rows per group without a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGE_GROUP = 200_000
CUTS = 64


def _ordered_number(df: DataFrame, name: str) -> Column:
    """A number that never falls where the column rises: for texts, that of their first six bytes."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).cast("double")
    head = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    first: Column,
    ties: Sequence[str],
    out: str = "rank",
    large_group: int = LARGE_GROUP,
) -> DataFrame:
    """Number the rows of each group 1..n by ``first`` ascending, then the ``ties`` columns ascending.

    ``first`` must be numeric; ties may be of any ordered type. Groups above ``large_group`` rows are cut at
    sketched quantiles of ``first``; rows that share a cut value are cut again by the first
    tie. Each piece is numbered on its own and shifted by the rows before it, so no task
    sorts a whole large group and the numbers stay exact whatever the cuts are.
    """
    keyed = df.withColumn("_first", first.cast("double")).withColumn("_tie", _ordered_number(df, ties[0]))
    marks = [k / CUTS for k in range(1, CUTS)]
    cuts = (
        keyed.groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            F.percentile_approx("_first", marks, 1000).alias("_cuts"),
            F.percentile_approx("_tie", marks, 1000).alias("_tie_cuts"),
        )
        .filter(F.col("_n") > large_group)
        .drop("_n")
    )
    placed = keyed.join(cuts, list(keys), "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_first")))
    on_cut = F.array_contains("_cuts", F.col("_first"))
    part = F.when(F.col("_cuts").isNull() | F.col("_first").isNull(), F.lit(0)).otherwise(below * 2 + on_cut.cast("int"))
    tie_below = F.size(F.filter("_tie_cuts", lambda c: c < F.col("_tie")))
    sub = F.when(F.coalesce(on_cut, F.lit(False)) & F.col("_tie").isNotNull(), tie_below).otherwise(0)
    pieces = placed.withColumn("_part", part).withColumn("_sub", sub).drop("_cuts", "_tie_cuts")
    sizes = pieces.groupBy(*keys, "_part", "_sub").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part", "_sub")) - F.col("_size")
    offsets = sizes.select(*keys, "_part", "_sub", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part", "_sub").orderBy("_first", *ties))
    numbered = pieces.withColumn("_local", local).join(offsets, [*keys, "_part", "_sub"])
    return numbered.withColumn(out, F.col("_before") + F.col("_local")).select(*df.columns, out)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group by ``order``, numbered 1..k.

    A row_number with a bound lets Spark keep k rows per group on the map side already, so
    a large group never reaches one task whole.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, number).filter(F.col(out) <= k)


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per group, by a map-side combined aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")
