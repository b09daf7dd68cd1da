"""Queries that run as streams over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.streaming import clips


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/raw_clips.parquet"
    schema = spark.read.parquet(path).select("id", "duration", "ingested_at").schema
    # A pattern, as the source takes a single file only by one.
    return clips.run_to_table(clips.counts_by_window(clips.clip_stream(spark, path[:-1] + "[t]", schema)), "complete")


QUERIES = {"stream_daily_counts": stream_daily_counts}
SQL = {"stream_daily_counts": "SELECT date_trunc('day', ingested_at)::TIMESTAMP AS start, count(*) AS n_rows, count(*) FILTER (duration < 1.0) AS n_short, count(*) FILTER (duration > 30.0) AS n_long FROM raw_clips GROUP BY 1"}
