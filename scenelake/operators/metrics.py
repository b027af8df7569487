"""Quality of predictions: classification, boxes, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.boxes import iou


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of 0/1 predictions."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )

    def ratio(a, b):
        return a / F.nullif(b, F.lit(0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "accuracy": ratio(tp + F.col("tn"), F.col("n")),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(tp * 2, tp * 2 + fp + fn),
        }
    )


def box_metrics(truth: DataFrame, predicted: DataFrame, item: str = "item_id", threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean IoU and recall at a threshold of one box per item; a missing prediction counts 0."""
    fields = ("ymin", "xmin", "ymax", "xmax")
    t = truth.select(item, *keys, F.struct(*fields).alias("t"))
    p = predicted.select(item, F.struct(*fields).alias("p"))
    scored = t.join(p, item, "left").withColumn("iou", F.when(F.col("p").isNotNull(), iou("t", "p")).otherwise(0.0))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("iou").alias("miou"), F.avg((F.col("iou") >= threshold).cast("double")).alias("recall")
    )


def calibration_error(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal confidence bins."""
    at = F.least(F.floor(F.col(confidence) * float(bins)), F.lit(bins - 1))
    binned = df.groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf")
    )
    gap = F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf")))
    return binned.agg(F.sum("n").alias("n"), (gap / F.sum("n")).alias("ece"))
