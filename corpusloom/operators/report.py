"""One-row aggregates as (metric, value) rows, and as report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivoted(row: DataFrame, kind: str = "double") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast(kind).alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def report_lines(row: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(line_no, line): 'label: value' per column of a one-row frame, in its order."""
    pairs = F.array(*[F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(f"{(labels or {}).get(c, c)}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))).alias("line")) for i, c in enumerate(row.columns, 1)])
    return row.select(F.explode(pairs).alias("p")).select("p.line_no", "p.line")
