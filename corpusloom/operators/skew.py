"""Joining rows to one row per key when a few keys hold most of the rows.

A key that holds at least ``share`` of all rows is hot; there are at most 1/share of those, so their list can be
broadcast whatever the size of the data. Rows of a hot key are spread over ``salts`` partitions and the key's
single row is repeated for each of them; all other keys are joined as usual. No row is dropped, no group is
gathered in one task, and nothing depends on sizes that the planner may not know.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE, LEAST, SALTS = 0.001, 100_000, 64
HOT, SALT = "__hot", "__salt"


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], counted: str, spread: Column, total: int | None = None, share: float = SHARE, least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row per combination of ``keys`` and in ``counted`` its
    number of rows (dropped from the result). ``spread`` tells rows of one key apart.

    Null keys match nothing. ``total``: number of rows, by default the sum of ``counted``; ``least``: keys of fewer
    rows are never hot. Empty sides give no rows. ``per_key`` is read more than once: pass a table.
    """
    held, most = per_key.agg(F.sum(counted), F.max(counted)).first()
    bound = max(float(least), share * ((held or 0) if total is None else total))
    if (most or 0) < bound:
        return rows.join(per_key.drop(counted), keys)
    hot = per_key.filter(F.col(counted) >= bound).select(*keys, F.lit(True).alias(HOT)).limit(math.ceil(1 / share) + 1)
    salt = F.when(F.col(HOT), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(SALT, salt).drop(HOT)
    repeated = per_key.withColumn(SALT, F.explode(F.when(F.col(counted) >= bound, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(counted)
    return salted.join(repeated, [*keys, SALT]).drop(SALT)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, total: int | None = None, share: float = SHARE, least: int = LEAST, salts: int = SALTS) -> DataFrame:
    """Inner join of two sides that may both hold many rows of a key. Rows of ``left`` of a hot key, one that holds at
    least ``share`` of its rows, are spread by ``spread`` over ``salts`` partitions, and the rows of ``right`` of that
    key are repeated for each: no task has all pairs of a hot key. Null keys match nothing. Both sides are read twice."""
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if total is None:
        total = left.count()
    bound = max(float(least), share * total)
    hot = counted.filter(F.col("__n") >= bound).select(*keys, F.lit(True).alias(HOT)).limit(math.ceil(1 / share) + 1).collect()
    if not hot:
        return left.join(right, keys)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*keys, F.lit(True).alias(HOT)).schema))  # at most 1/share keys
    one = F.lit(0).cast("int")
    salted = left.join(hot, keys, "left").withColumn(SALT, F.when(F.col(HOT), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(one).cast("int")).drop(HOT)
    repeated = right.join(hot, keys, "left").withColumn(SALT, F.explode(F.when(F.col(HOT), F.sequence(one, F.lit(salts - 1))).otherwise(F.array(one)))).drop(HOT)
    return salted.join(repeated, [*keys, SALT]).drop(SALT)
