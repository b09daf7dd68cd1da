"""Queries of the heavy-key aggregation (problem 1) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.hotkeys import any_of, count_rows, greatest, heavy_keys, least, measured, total, tree_aggregate

TABLES = (("raw_clips", "text_raw"), ("train_clips", "cleaned_text"))
SHARE = 0.02
#: Not whitespace to the engine's trim, but blank to a reader.
BLANK = r"^[\s\p{Z}\p{Cf}]*$"


def keyed(spark: SparkSession, sf: str, tab: str, column: str) -> DataFrame:
    """The rows with a 128-bit digest of their text, which stands for it in every round."""
    return spark.read.parquet(f"{sf}/{tab}.parquet").select("id", "duration", F.col(column).alias("text")).withColumn("k", F.unhex(F.md5("text")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The tree works on digests; the texts of the few heavy keys (at most 1/SHARE) come from the row of the first id."""
    parts = []
    for tab, column in TABLES:
        df = keyed(spark, sf, tab, column)
        size = measured(df)
        states = [count_rows(), least(F.col("id"), "first_id")]
        heavy = heavy_keys(tree_aggregate(df.filter("k IS NOT NULL"), {"k": F.col("k")}, states, size=size), "n_rows", SHARE, size.rows)
        text = df.join(F.broadcast(heavy.select("k", F.col("first_id").alias("id"))), ["k", "id"])
        first = text.groupBy("k").agg(F.min("id").alias("first_id"), F.any_value("text").alias("text_key"))
        parts.append(first.select(F.lit(tab).alias("tab"), "text_key", "first_id"))
    return parts[0].unionByName(parts[1]).filter(~F.col("text_key").rlike(BLANK))


def per_text(spark: SparkSession, sf: str, tab: str, column: str) -> DataFrame:
    """Row count, smallest id and exact duration total (in whole milliseconds) of every stored text."""
    ms = F.when(F.isnan("duration") | F.col("duration").isNull(), F.lit(0)).otherwise(F.round(F.col("duration") * 1000)).cast("bigint")
    states = [any_of(F.col("text"), "text_key"), count_rows(), least(F.col("id"), "first_id"), total(ms, "sum_ms"), greatest(ms, "max_ms")]
    return tree_aggregate(keyed(spark, sf, tab, column), {"k": F.col("k")}, states).drop("k")


def p1_text_totals(spark: SparkSession, sf: str) -> DataFrame:
    parts = [per_text(spark, sf, tab, column).select(F.lit(tab).alias("tab"), "*") for tab, column in TABLES]
    return parts[0].unionByName(parts[1])


QUERIES = {"p1_found": p1_found, "p1_text_totals": p1_text_totals}

_PER = "SELECT '{tab}' AS tab, {col} AS text_key, count(*) AS n_rows, min(id) AS first_id, sum(CAST(coalesce(round(duration * 1000), 0) AS BIGINT))::BIGINT AS sum_ms, max(CAST(coalesce(round(duration * 1000), 0) AS BIGINT)) AS max_ms FROM {tab} GROUP BY 2"
SQL = {
    "p1_found": " UNION ALL ".join(f"SELECT tab, text_key, first_id FROM ({_PER.format(tab=t, col=c)}) WHERE n_rows >= {SHARE} * (SELECT count(*) FROM {t}) AND text_key IS NOT NULL AND NOT regexp_matches(text_key, '^[\\s\\p{{Z}}\\p{{Cf}}]*$')" for t, c in TABLES),
    "p1_text_totals": " UNION ALL ".join(_PER.format(tab=t, col=c) for t, c in TABLES),
}
