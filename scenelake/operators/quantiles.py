"""Exact interpolated quantiles per group without holding a group in one task.

Pass one takes a bounded, mergeable sketch per group. Pass two keeps exact counts only
for the narrow value bracket the sketch gives around each wanted rank and one count for
everything below it, so the rows that reach a group's window are a small share of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(counted: DataFrame, keys: Sequence[str], probs: Column, total: Column) -> DataFrame:
    """Order statistics around one rank per group; counted has value (NULL = below the bracket), n."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()))
    position = (total - 1) * probs
    ranked = counted.withColumn("upto", upto).withColumn("position", position)
    low, high = F.floor("position"), F.ceil("position")
    found = ranked.groupBy(*keys).agg(
        F.max("position").alias("position"),
        F.min(F.when(F.col("upto") > low, F.col("value"))).alias("v_low"),
        F.min(F.when(F.col("upto") > high, F.col("value"))).alias("v_high"),
        F.max(F.when(F.col("value").isNull() & (F.col("upto") > low), True).otherwise(False)).alias("missed"),
    )
    sound = F.when(
        F.col("missed") | F.col("v_low").isNull() | F.col("v_high").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank; raise the accuracy")).cast("double"),
    ).otherwise(F.col("v_low") + (F.col("v_high") - F.col("v_low")) * (F.col("position") - F.floor("position")))
    return found.select(*keys, sound.alias("q"))


def _wide(picked: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == i, F.col("q"))).alias(name) for i, name in enumerate(names)]
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    accuracy: int = 10000,
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles of its non-NULL values."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    data = df.select(*keys, F.col(value).cast("double").alias("value")).filter("value is not null")
    margin = 4.0 / accuracy
    marks = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        F.percentile_approx("value", [float(m) for m in marks], accuracy).alias("marks"),
    )
    small = F.col("total") <= accuracy
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("_p"),
                F.lit(float(p)).alias("prob"),
                (F.col("lowest") if p - margin <= 0 else F.when(small, F.col("lowest")).otherwise(F.col("marks")[i])).alias("lo"),
                (
                    F.col("highest")
                    if p + margin >= 1
                    else F.when(small, F.col("highest")).otherwise(F.col("marks")[len(probs) + i])
                ).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    plan = sketch.select(*keys, "total", brackets.alias("brackets"))
    hits = (
        data.join(plan, list(keys))
        .select(*keys, "value", "total", F.explode("brackets").alias("b"))
        .filter(F.col("value") <= F.col("b.hi"))
        .select(
            *keys,
            "total",
            F.col("b._p").alias("_p"),
            F.col("b.prob").alias("prob"),
            F.when(F.col("value") >= F.col("b.lo"), F.col("value")).alias("value"),
        )
    )
    counted = hits.groupBy(*keys, "_p", "prob", "total", "value").agg(F.count("*").alias("n"))
    picked = _pick(counted, [*keys, "_p"], F.col("prob"), F.col("total"))
    return _wide(picked, keys, names)


def counted_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    n: str = "n",
) -> DataFrame:
    """Quantiles from (value, count) rows, for values of a bounded range such as raster rows."""
    data = counts.select(*keys, F.col(value).cast("double").alias("value"), F.col(n).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))
    ranked = data.withColumn("total", total).withColumn("upto", upto)
    aggs, outs = [], []
    for p, name in zip(probs, names):
        position = (F.col("total") - 1) * float(p)
        aggs += [
            F.max(position).alias(f"{name}_pos"),
            F.min(F.when(F.col("upto") > F.floor(position), F.col("value"))).alias(f"{name}_lo"),
            F.min(F.when(F.col("upto") > F.ceil(position), F.col("value"))).alias(f"{name}_hi"),
        ]
        lo, hi, pos = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_pos")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)
