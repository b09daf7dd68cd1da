"""Label batches as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED, MAX_LABELS = -100, 448


def truncated(labels: Column, most: int = MAX_LABELS) -> Column:
    return F.slice(labels, 1, most)


def padded(df: DataFrame, labels: str, batch: str, fill: int = IGNORED) -> DataFrame:
    """Each array filled up to the longest of its batch. Batches are small by nature: a window over them is bounded."""
    longest = F.max(F.size(labels)).over(Window.partitionBy(batch))
    return df.withColumn(labels, F.concat(labels, F.array_repeat(F.lit(fill).cast("int"), (longest - F.size(labels)).cast("int"))))


def without_start(df: DataFrame, labels: str, batch: str, start: int) -> DataFrame:
    """The first token dropped where every array of the batch begins with ``start``."""
    all_ = F.bool_and(F.coalesce(F.get(F.col(labels), F.lit(0)) == start, F.lit(False))).over(Window.partitionBy(batch))
    return df.withColumn("__all", all_).withColumn(labels, F.when(F.col("__all"), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))).otherwise(F.col(labels))).drop("__all")


def unmasked(labels: Column, pad: int, fill: int = IGNORED) -> Column:
    return F.transform(labels, lambda x: F.when(x == fill, F.lit(pad).cast("int")).otherwise(x))
