"""Deduplication and the cleaning funnel over raw_clips, in either order of its steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions import text as T
from corpusloom.functions.wav import with_seconds
from corpusloom.operators import dedup, joins, metrics
from corpusloom.plans import sqltext as Q
from corpusloom.sources import shards, sinks


def prepared(spark: SparkSession, sf: str, headers: bool = True) -> DataFrame:
    """id, audio key, null-safe text, and the duration: with ``headers`` by the header of the clip, null where it is
    corrupt, else as stored. The audio bytes stay in the scan, but for those of another layout than the common one."""
    df = spark.read.parquet(f"{sf}/raw_clips.parquet")
    columns = ("id", T.audio_key("audio").alias("audio_key"), T.null_safe(F.col("text_raw")).alias("text_raw"))
    return with_seconds(df, "audio.bytes", "duration", *columns) if headers else df.select(*columns, "duration")


def formed(df: DataFrame, collapse: bool = True) -> DataFrame:
    """``df`` plus the normal form of its text and that form's fingerprint."""
    return df.withColumn("normalized", T.Profile(collapse=collapse)(F.col("text_raw"))).withColumn("fingerprint", T.fingerprint(F.col("normalized")))


def valid(df: DataFrame) -> DataFrame:
    return df.filter(metrics.in_range(F.col("duration")))


def once(df: DataFrame) -> DataFrame:
    return dedup.exact_dedup(df, ["audio_key", "text_raw"], "id")


def cleaned(spark: SparkSession, sf: str, collapse: bool = True) -> DataFrame:
    return dedup.capped(formed(once(valid(prepared(spark, sf))), collapse), "fingerprint", "normalized", "id")


def funnel(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts that add up: raw = corrupt + short + long + exact copies + excess + kept.

    One scan: each row gets its reason, the valid ones a digest of their key; then one aggregate per (reason, digest)
    and one per (reason, fingerprint). Nothing longer than a digest is shuffled.
    """
    s = F.col("duration")
    reason = F.when(s.isNull(), "corrupt").when(s < metrics.SHORTEST, "short").when(s > metrics.LONGEST, "long").otherwise("ok")
    ok = F.col("reason") == "ok"
    digest = lambda c: F.when(ok, F.unhex(F.md5(c)))
    rows = formed(prepared(spark, sf)).withColumn("reason", reason).select(
        "id", "reason", digest(F.concat_ws(",", "audio_key", F.md5("text_raw"))).alias("d"), digest(F.col("fingerprint")).alias("f"), (ok & T.is_short(F.col("normalized"))).alias("brief")
    )
    keys = rows.groupBy("reason", "d").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id"), F.min_by(F.struct("f", "brief"), "id").alias("x"))
    per = keys.groupBy("reason", "x.f").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.min_by("x.brief", "id").alias("brief"))
    excess = F.when(F.col("brief"), F.lit(0)).otherwise(F.greatest(F.col("n") - dedup.CAP, F.lit(0)))
    count = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("bigint")
    is_ = lambda r: F.col("reason") == r
    return per.agg(
        count(F.lit(True), F.col("rows")).alias("n_raw"), *[count(is_(r), F.col("rows")).alias(f"n_{r}") for r in ("corrupt", "short", "long")],
        count(ok, F.col("rows") - F.col("n")).alias("n_exact_copies"), count(ok, excess).alias("n_excess"), count(ok, F.col("n") - excess).alias("n_kept"),
    )


def _exact(spark, sf):
    return once(prepared(spark, sf, headers=False)).select("id", "audio_key", "text_raw", "duration")


def _capped(spark, sf):
    return cleaned(spark, sf).select("id", "text_raw", F.col("normalized").alias("cleaned_text"), "duration")


def _before(spark, sf):
    kept = dedup.capped(formed(once(prepared(spark, sf)), collapse=False), "fingerprint", "normalized", "id")
    return valid(kept).select("id", "fingerprint")


def _after(spark, sf):
    return cleaned(spark, sf, collapse=False).select("id", "fingerprint")


def _trio(spark, sf):
    """The cleaned set and its two parts, written as CSV and read back: one row per record and file."""
    folder = f"{runtime.shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    runtime._scratch.append((spark, folder))
    whole = runtime.table(_capped(spark, sf).select("id", "duration", "text_raw", "cleaned_text"))
    sinks.write_splits(whole, folder)
    parts = [shards.read_labels(spark, f"{folder}/{name}").select("id", "cleaned_text", F.lit(name).alias("file")) for name in ("cleaned", "train", "val")]
    return joins.stacked(*parts)


QUERIES = {
    "exact_dedup": _exact,
    "duplicate_counts": lambda spark, sf: dedup.duplicate_count(prepared(spark, sf, False), "audio_key", "text_raw"),
    "fingerprint_cap": _capped,
    "dup_excess_count": lambda spark, sf: dedup.excess_count(formed(once(valid(prepared(spark, sf)))), "fingerprint", "normalized", "id"),
    "dup_breakdown": lambda spark, sf: dedup.breakdown(formed(once(prepared(spark, sf, False)), False), "fingerprint", "normalized", "id"),
    "frequency_table": lambda spark, sf: dedup.frequencies(formed(prepared(spark, sf, False)), "fingerprint"),
    "dedup_before_filter": _before,
    "dedup_after_filter": _after,
    "cleaning_funnel": funnel,
    "split_files": _trio,
}


def _prepared(collapse: bool = True, headers: bool = True) -> str:
    seconds = Q.wav_seconds("h") if headers else "duration"
    return f"""raw AS (SELECT id, {seconds} AS duration, audio_key, text_raw FROM (SELECT id, duration, hex(audio.bytes) AS h, {Q.audio_key()} AS audio_key, coalesce(text_raw, '') AS text_raw FROM raw_clips)),
        norm AS (SELECT *, {Q.normalized('text_raw', collapse)} AS normalized FROM raw), prep AS (SELECT *, {Q.fingerprint('normalized')} AS fingerprint FROM norm)"""


_VALID = "duration BETWEEN 1.0 AND 30.0"
_ONCE = "SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY audio_key, text_raw ORDER BY id) = 1"
_RANKED = f"SELECT *, {Q.is_short('first_text')} AS short FROM (SELECT *, row_number() OVER w AS rn, first_value(normalized) OVER w AS first_text, count(*) OVER (PARTITION BY fingerprint) AS n FROM once WINDOW w AS (PARTITION BY fingerprint ORDER BY id))"


def _sql(tail: str, collapse: bool = True, filtered: bool = True, headers: bool = True) -> str:
    return f"WITH {_prepared(collapse, headers)}, valid AS (SELECT * FROM prep WHERE {_VALID}), once AS ({_ONCE.format(src='valid' if filtered else 'prep')}), ranked AS ({_RANKED}) {tail}"


SQL = {
    "exact_dedup": _sql("SELECT id, audio_key, text_raw, duration FROM once", filtered=False, headers=False),
    "duplicate_counts": f"WITH {_prepared(headers=False)} SELECT (SELECT count(*) FROM prep) - (SELECT count(*) FROM (SELECT DISTINCT audio_key, text_raw FROM prep)) AS n_duplicates",
    "fingerprint_cap": _sql("SELECT id, text_raw, normalized AS cleaned_text, duration FROM ranked WHERE short OR rn <= 3"),
    "dup_excess_count": _sql("SELECT count(DISTINCT fingerprint) AS n_groups, count(*) FILTER (rn > 3)::BIGINT AS n_excess FROM ranked WHERE NOT short AND n > 3"),
    "dup_breakdown": _sql(
        """, k AS (SELECT fingerprint, CASE WHEN short THEN 'short_kept' WHEN n <= 3 THEN 'long_within_cap' WHEN rn <= 3 THEN 'long_over_cap_kept' ELSE 'long_over_cap_dropped' END AS kind FROM ranked WHERE n > 1),
        kinds AS (SELECT unnest(['short_kept', 'long_within_cap', 'long_over_cap_kept', 'long_over_cap_dropped']) AS kind)
        SELECT kinds.kind, count(k.kind) AS n_rows, count(DISTINCT k.fingerprint) AS n_texts FROM kinds LEFT JOIN k ON k.kind = kinds.kind GROUP BY 1""", False, False, False),
    "frequency_table": f"WITH {_prepared(headers=False)} SELECT fingerprint, count(*) AS n FROM prep GROUP BY 1 HAVING count(*) > 1",
    "dedup_before_filter": _sql(f"SELECT id, fingerprint FROM ranked WHERE (short OR rn <= 3) AND {_VALID}", False, False),
    "dedup_after_filter": _sql("SELECT id, fingerprint FROM ranked WHERE short OR rn <= 3", False),
    "cleaning_funnel": _sql("""SELECT (SELECT count(*) FROM prep) AS n_raw, (SELECT count(*) FROM prep WHERE duration IS NULL) AS n_corrupt,
        (SELECT count(*) FROM prep WHERE duration < 1.0) AS n_short, (SELECT count(*) FROM prep WHERE duration > 30.0) AS n_long,
        (SELECT count(*) FROM valid) - (SELECT count(*) FROM once) AS n_exact_copies, (SELECT count(*) FROM ranked WHERE NOT short AND rn > 3) AS n_excess, (SELECT count(*) FROM ranked WHERE short OR rn <= 3) AS n_kept"""),
    "split_files": _sql(""", kept AS (SELECT id, nullif(normalized, '') AS cleaned_text, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', id)), id) <= ceil(0.15 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS file FROM ranked WHERE short OR rn <= 3)
        SELECT id, cleaned_text, file FROM kept UNION ALL SELECT id, cleaned_text, 'cleaned' FROM kept"""),
}
