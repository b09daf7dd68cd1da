"""The duration filter, exact deduplication and counts of the batch operators on a stream of clip shards.

The batch reference has no streams; this is the same Column logic under Structured Streaming. Late rows are
dropped once the watermark has passed them, and so is the state that they would need.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom import runtime
from corpusloom.operators import metrics

LATE = "120 days"


def clip_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet shards under ``path`` as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(clips: DataFrame, at: str, late: str) -> DataFrame:
    """A watermark needs an instant: a time without zone is taken in the session's."""
    return clips.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def first_copies(clips: DataFrame, keys: list[str], at: str = "ingested_at", late: str = LATE) -> DataFrame:
    """Rows in the valid range, the first seen of each key; a key is remembered for ``late`` of event time."""
    kept = clips.filter(metrics.in_range(F.col("duration")))
    return _timed(kept, at, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(clips: DataFrame, at: str = "ingested_at", width: str = "1 day", late: str = LATE) -> DataFrame:
    """(start, n_rows, n_short, n_long) per tumbling window of event time."""
    s = metrics.known(F.col("duration"))
    counted = _timed(clips, at, late).groupBy(F.window(at, width).alias("w"))
    return counted.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(s < metrics.SHORTEST).alias("n_short"), F.count_if(s > metrics.LONGEST).alias("n_long")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n_rows", "n_short", "n_long")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there now and return the result, written to the shared folder with its checkpoint."""
    spark = stream.sparkSession
    base = f"{runtime.shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    runtime._scratch.append((spark, base))
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        sink = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    sink.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
