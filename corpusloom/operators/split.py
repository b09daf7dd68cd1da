"""Splits and subsets of exact size, reproducible and without a global sort.

Rows are ordered by (md5 of seed and key, key). The row at a given rank is found by counting hash prefixes: each
pass narrows the range by 16 bits until few rows are left, so no task sees more than it can hold and only the
cut itself reaches the driver. A row's side then depends on nothing but its own key and that cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 50_000


def order_hash(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def cut_at(df: DataFrame, key: str, rank: int, seed: int = 42, few: int = FEW) -> tuple[str, object] | None:
    """(hash, key) of the row of this 1-based rank; None when there are fewer rows or rank < 1. Null keys have no rank."""
    if rank < 1:
        return None
    rows = df.filter(F.col(key).isNotNull()).select(order_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    prefix = ""
    while True:
        here = rows.filter(F.col("h").startswith(prefix)) if prefix else rows
        width = len(prefix) + 4
        if width > 32:  # one hash: keys that are all alike, or nearly; counted key by key
            per = here.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").limit(rank).toLocalIterator()
            for r in per:
                if rank <= r.n:
                    return r.h, r.k
                rank -= r.n
            return None
        if here.limit(few + 1).count() <= few:
            top = here.orderBy("h", "k").limit(rank).collect()
            return (top[rank - 1].h, top[rank - 1].k) if len(top) >= rank else None
        counts = here.groupBy(F.substring("h", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65,536
        for p, n in sorted((r.p, r.n) for r in counts):
            if rank <= n:
                prefix = p
                break
            rank -= n
        else:
            return None


def _until(key: str, cut: tuple[str, object], seed: int) -> Column:
    h = order_hash(F.col(key), seed)
    return (h < cut[0]) | ((h == cut[0]) & (F.col(key) <= F.lit(cut[1])))


def train_val(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` plus ``split``: exactly ceil(share * n) of the n rows with a key are 'val'. Keys must be unique; rows
    without one are 'train'."""
    cut = cut_at(df, key, math.ceil(share * df.filter(F.col(key).isNotNull()).count()), seed)
    val = F.coalesce(_until(key, cut, seed), F.lit(False)) if cut else F.lit(False)
    return df.withColumn("split", F.when(val, "val").otherwise("train"))


def subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with a key, or all of these where there are fewer."""
    cut = cut_at(df, key, n, seed)
    return df.filter(_until(key, cut, seed)) if cut else df.filter(F.col(key).isNotNull() if n > 0 else F.lit(False))
