"""Per-key results when a few keys hold most rows: aggregation as a tree over fixed-size input chunks.

A leaf is a run of ``chunk`` rows of one input split; it combines its rows to one state per key. The states then
merge in rounds of ``fan_in``: round r groups by (key, leaf // fan_in**r), so no task ever receives more than
``fan_in`` nodes' states of one key, and the number of rounds is the logarithm of the number of leaves. Leaves are
numbered by split and position, and there are as many rounds on few splits as the rows ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "__node"
CHUNK, FAN_IN = 2048, 16
#: Rows of one split are numbered from a multiple of this (what monotonically_increasing_id gives).
SPLIT = 1 << 33


@dataclass(frozen=True)
class Merge:
    """A state: ``first`` makes it from a leaf's rows, ``again`` merges states of the same name."""

    name: str
    first: Column
    again: str = "sum"


def count_rows(name: str = "n_rows") -> Merge:
    return Merge(name, F.count(F.lit(1)))


def total(column: Column, name: str) -> Merge:
    return Merge(name, F.sum(column))


def least(column: Column, name: str) -> Merge:
    return Merge(name, F.min(column), "min")


def greatest(column: Column, name: str) -> Merge:
    return Merge(name, F.max(column), "max")


def any_of(column: Column, name: str) -> Merge:
    """Any one value; for what is the same in all rows of a key."""
    return Merge(name, F.any_value(column), "any")


@dataclass(frozen=True)
class Size:
    """Splits of an input, rows of the largest, rows of all."""

    splits: int
    largest: int
    rows: int


def measured(df: DataFrame) -> Size:
    """One pass that reads no column: a columnar source answers it from its footers."""
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    last, most, n = per.agg(F.max("p"), F.max("n"), F.sum("n")).first()
    return Size((last or 0) + 1, most or 0, n or 0)


def tree_aggregate(df: DataFrame, key: dict[str, Column], states: list[Merge], fan_in: int = FAN_IN, chunk: int = CHUNK, size: Size | None = None) -> DataFrame:
    """One row per key with the merged states.

    Null keys form one group of their own. An empty input gives no rows. Repeated rows count as often as they
    occur; ties of min and max give the same value whichever row wins. Columns of ``df`` that are not used are
    not read; only the names in ``key`` and ``states`` appear in the result, so other columns cannot clash.
    ``size`` is that of :func:`measured`, if it is known; a wrong one changes the balance, never the result.
    """
    if fan_in < 2 or chunk < 1:
        raise ValueError("fan_in must be at least 2 and chunk at least 1")
    merge = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.any_value}
    names = list(key)
    size = size or measured(df)
    per_split = max(1, -(-size.largest // chunk))
    leaves = size.splits * per_split
    rounds = 1
    while fan_in**rounds < leaves:
        rounds += 1
    at = F.monotonically_increasing_id()
    row = at % F.lit(SPLIT)
    leaf = F.floor(at / F.lit(SPLIT)) * F.lit(per_split) + F.least(F.floor(row / F.lit(chunk)), F.lit(per_split - 1))
    # The leaf number is fixed in a projection below the first exchange. Level r has a node for each fan_in**r leaves;
    # the root, level ``rounds``, has no number.
    out = df.withColumn(NODE, leaf.cast("bigint"))
    by = [c.alias(k) for k, c in key.items()]
    into = [s.first.alias(s.name) for s in states]
    for r in range(1, rounds + 1):
        node = [] if r == rounds else [F.floor(F.col(NODE) / F.lit(fan_in)).cast("bigint").alias(NODE)]
        out = out.groupBy(*by, *node).agg(*into)
        by, into = names, [merge[s.again](s.name).alias(s.name) for s in states]
    return out


def heavy_keys(per_key: DataFrame, counted: str, share: float, rows: int | None = None) -> DataFrame:
    """Rows of ``per_key`` whose ``counted`` is at least ``share`` of ``rows``, by default the sum of ``counted`` over all
    keys (which evaluates ``per_key`` once more).

    At most 1/share rows remain. An empty input gives no rows.
    """
    whole = F.lit(rows) if rows is not None else per_key.agg(F.sum(counted)).scalar()
    return per_key.filter(F.col(counted) >= F.lit(share) * whole)
