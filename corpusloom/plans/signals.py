"""Signals: array functions over embeddings as waveforms, WAV functions over raw_clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import audio, signal, wav
from corpusloom.plans import sqltext as Q
from corpusloom.plans.measures import WAV_SQL

RATE, TOP_DB = 400, 6.0


def waves(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def stats(spark, sf):
    return waves(spark, sf).select("vec_id", F.round(signal.peak(F.col("x")), 9).alias("peak"), F.round(signal.rms(F.col("x")), 9).alias("rms"))


def flags(spark, sf):
    """Thresholds around the waves' own level, so that the flags vary."""
    s = stats(spark, sf)
    return s.agg(F.count_if(signal.is_silent(F.col("peak"), F.col("rms"), 0.3, 0.01)).alias("n_silent"), F.count_if(signal.is_clipped(F.col("peak"), 0.4)).alias("n_clipped"))


def normalized(spark, sf):
    n = signal.peak_normalized(F.col("x"))
    return waves(spark, sf).select("vec_id", F.round(F.array_max(F.transform(n, F.abs)), 9).alias("peak"), F.round(F.aggregate(n, F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


def trimmed(spark, sf):
    t = signal.trimmed(F.col("x"), RATE, TOP_DB, margin_ms=0.0, min_seconds=0.02)
    return waves(spark, sf).select("vec_id", F.size(t).alias("n"), F.round(F.element_at(t, 1), 9).alias("first"), F.round(F.element_at(t, -1), 9).alias("last"))


def resampled(spark, sf):
    r = signal.resampled(F.col("x"), F.lit(64), 100)
    return waves(spark, sf).select("vec_id", F.size(r).alias("n"), F.round(F.aggregate(r, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def clips(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/raw_clips.parquet")


def wav_duration(spark, sf):
    return clips(spark, sf).select("id", F.coalesce(wav.plain_seconds(F.col("audio.bytes")), F.lit(-1.0)).alias("seconds"))


def wav_signal(spark, sf):
    """Header and signal figures of every clip; undecodable ones count as silent."""
    df = wav.with_signal(clips(spark, sf), "audio.bytes", ["id"]).withColumn("rms", F.round("rms", 9))
    return df.withColumns({"silent": signal.is_silent(F.col("peak"), F.col("rms")), "clipped": signal.is_clipped(F.col("peak"))})


def shard_hashes(spark, sf):
    """The bytes become their digest in the scan."""
    return clips(spark, sf).select("id", F.md5("audio.bytes").alias("audio_md5"), "duration")


def _levels(df: DataFrame, key: str) -> DataFrame:
    return audio.with_levels(df, "audio", [key]).select(key, "n_in", "n_out", F.round("peak", 9).alias("peak"), F.round("total", 6).alias("total"))


def clip_levels(spark, sf):
    """Every clip decoded, mixed down, resampled, trimmed and levelled as by default. A third of the ids come as arrays at
    8 kHz instead of bytes."""
    third = F.col("id") % 3 == 0
    wave = F.array((F.col("id") % 7) * 0.1, F.lit(-0.5), F.lit(0.25))
    source = F.struct(F.when(third, wave).alias("array"), F.when(third, F.lit(8000)).alias("sampling_rate"), F.col("audio.bytes").alias("bytes"), F.col("audio.path").alias("path"))
    return _levels(clips(spark, sf).select("id", source.alias("audio")), "id")


#: Three seconds at 16 kHz, silent but for a stretch that begins and ends later from one supplier to the next.
LENGTH, QUIET, LOUD = 48_000, 0.0001, 0.4
#: Rows of a task that makes such arrays: about 100 MB of them.
LONG_ROWS = 256


def _stretch(begin: Column, end: Column) -> Column:
    """LENGTH samples, quiet but for those from ``begin`` up to before ``end``, which are loud and change their sign; all
    are quiet where either is null. Made of repeats, as a lambda is interpreted for each sample."""
    a = F.when(begin.isNull() | end.isNull(), LENGTH).otherwise(F.greatest(F.lit(0), F.least(begin, F.lit(LENGTH)))).cast("int")
    b = F.greatest(a, F.least(end, F.lit(LENGTH)).cast("int"))
    quiet = lambda n: F.array_repeat(F.lit(QUIET), n)
    pairs = F.flatten(F.array_repeat(F.array(F.lit(LOUD), F.lit(-LOUD / 2)), F.ceil((b - a) / 2).cast("int") + 1))
    return F.concat(quiet(a), F.slice(pairs, a % 2 + 1, b - a), quiet(F.lit(LENGTH) - b))


def clip_trim(spark, sf):
    """Trimming and levelling at their default settings on long arrays. The table is small, the arrays are not: its rows
    are spread over the tasks before they are made."""
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-suppliers.count() // LONG_ROWS))
    begin = (F.col("s_suppkey") * 37) % 20_000
    source = F.struct(_stretch(begin, begin + 4_000 + F.col("s_nationkey") * 900).alias("array"), F.lit(16_000).alias("sampling_rate"))
    return _levels(suppliers.repartition(tasks).select("s_suppkey", source.alias("audio")), "s_suppkey")


def features(spark, sf):
    """Mean of each of the 128 bands of every clip's features of 30 s, as one row per clip."""
    df = audio.with_features(clips(spark, sf), "audio", ["id"], pooled=True)
    return df.select("id", "decode_ok", F.size("input_features").alias("bands"), F.round(F.aggregate("input_features", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


QUERIES = {"clip_levels": clip_levels, "clip_trim": clip_trim, "clip_features": features, "signal_stats": stats, "signal_flags": flags, "peak_normalize": normalized, "trim_silence": trimmed, "resample_linear": resampled, "wav_duration": wav_duration, "wav_signal": wav_signal, "shard_hashes": shard_hashes}

_X = "w AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
_PEAK = "list_max(list_transform(x, lambda v: abs(v)))"
_RMS = "sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))"
_GAIN = f"{10 ** (-3 / 20)!r}"
#: The samples of a plain clip as kept, of one channel and 16 bits, as all of the tables are.
_SAMPLES = f"list_transform(range(0, least({Q.le('h', 41)}, length(h) // 2 - 44) // 2), lambda i: (CASE WHEN {Q.le('h', '(45 + 2 * i)', 2)} >= 32768 THEN {Q.le('h', '(45 + 2 * i)', 2)} - 65536 ELSE {Q.le('h', '(45 + 2 * i)', 2)} END)::DOUBLE / 32768)"
_DECODED = f"""dec AS (SELECT id, h, CASE WHEN {Q.wav_plain('h')} AND {Q.le('h', 21, 2)} IN (1, 65534) AND {Q.le('h', 35, 2)} = 16 AND {Q.le('h', 23, 2)} = 1 THEN {_SAMPLES} END AS x FROM (SELECT id, hex(audio.bytes) AS h FROM raw_clips))"""


def _levelled(x: str) -> str:
    return f"CASE WHEN {_PEAK.replace('(x', f'({x}')} > 1e-8 THEN {_GAIN} / {_PEAK.replace('(x', f'({x}')} ELSE 1.0 END"


SQL = {
    "signal_stats": f"WITH {_X} SELECT vec_id, round({_PEAK}, 9) AS peak, round({_RMS}, 9) AS rms FROM w",
    "signal_flags": f"WITH {_X}, s AS (SELECT round({_PEAK}, 9) AS peak, round({_RMS}, 9) AS rms FROM w) SELECT count(*) FILTER (peak < 0.3 OR rms < 0.01) AS n_silent, count(*) FILTER (peak >= 0.4) AS n_clipped FROM s",
    "peak_normalize": f"WITH {_X}, n AS (SELECT vec_id, list_transform(x, lambda v: v * {10 ** (-3 / 20)!r} / p) AS y FROM (SELECT *, {_PEAK} AS p FROM w)) SELECT vec_id, round(list_max(list_transform(y, lambda v: abs(v))), 9) AS peak, round(list_sum(y), 9) AS total FROM n",
    "trim_silence": f"""WITH {_X}, f AS (SELECT vec_id, x, list_transform(range(0, len(x) // 8), lambda i: sqrt(list_sum(list_transform(x[i * 8 + 1:i * 8 + 8], lambda v: v * v)) / 8 + 1e-12)) AS e FROM w),
        b AS (SELECT vec_id, x, list_filter(range(0, len(e)), lambda i: e[i + 1] > list_max(e) * {10 ** (-TOP_DB / 20)!r}) AS voiced FROM f),
        t AS (SELECT vec_id, CASE WHEN (list_max(voiced) + 1) * 8 - list_min(voiced) * 8 >= 8 THEN x[list_min(voiced) * 8 + 1:(list_max(voiced) + 1) * 8] ELSE x END AS y FROM b)
        SELECT vec_id, len(y)::INT AS n, round(y[1], 9) AS "first", round(y[-1], 9) AS "last" FROM t""",
    "resample_linear": f"""WITH {_X}, r AS (SELECT vec_id, x, list_transform(range(0, 100), lambda i: i * (len(x) - 1)::DOUBLE / 99) AS pos FROM w)
        SELECT vec_id, 100 AS n, round(list_sum(list_transform(pos, lambda a: x[least(floor(a)::INT, len(x) - 1) + 1] + (x[least(least(floor(a)::INT, len(x) - 1) + 1, len(x) - 1) + 1] - x[least(floor(a)::INT, len(x) - 1) + 1]) * (a - least(floor(a)::INT, len(x) - 1)))), 6) AS total FROM r""",
    "wav_signal": f"""WITH {_DECODED} SELECT id, CASE WHEN x IS NOT NULL THEN {Q.le('h', 25)} END::INT AS rate, CASE WHEN x IS NOT NULL THEN 1 END AS channels, CASE WHEN x IS NOT NULL THEN 16 END AS bits,
        CASE WHEN x IS NOT NULL THEN {Q.le('h', 41)}::DOUBLE / ({Q.le('h', 25)} * 2) END AS seconds, len(x) AS frames, {_PEAK} AS peak, round({_RMS}, 9) AS rms,
        coalesce({_PEAK} < 0.001 OR round({_RMS}, 9) < 0.0001, true) AS silent, coalesce({_PEAK} >= 0.99, false) AS clipped FROM dec""",
    "clip_levels": f"""WITH {_DECODED}, src AS (SELECT id, x AS held, CASE WHEN id % 3 = 0 THEN [id % 7 * 0.1::DOUBLE, -0.5, 0.25] ELSE x END AS w FROM dec),
        r AS (SELECT id, len(w) AS n_in, CASE WHEN id % 3 = 0 THEN list_transform(range(0, 6), lambda i: w[i * 2 // 5 + 1] + (w[least(i * 2 // 5 + 2, 3)] - w[i * 2 // 5 + 1]) * (i * 2 % 5) / 5.0::DOUBLE) ELSE w END AS x FROM src)
        SELECT id, n_in, len(x) AS n_out, round({_PEAK} * g, 9) AS peak, round(list_sum(x) * g, 6) AS total FROM (SELECT *, {_levelled('x')} AS g FROM r)""",
    "clip_trim": f"""WITH w AS (SELECT s_suppkey, list_transform(range(0, {LENGTH}), lambda i: CASE WHEN i >= s_suppkey * 37 % 20000 AND i < s_suppkey * 37 % 20000 + 4000 + s_nationkey * 900 THEN CASE WHEN i % 2 = 0 THEN {LOUD} ELSE -{LOUD} / 2 END ELSE {QUIET} END::DOUBLE) AS x FROM supplier),
        f AS (SELECT s_suppkey, x, list_transform(range(0, len(x) // 320), lambda i: sqrt(list_sum(list_transform(x[i * 320 + 1:i * 320 + 320], lambda v: v * v)) / 320 + 1e-12)) AS e FROM w),
        v AS (SELECT *, list_filter(range(0, len(e)), lambda i: e[i + 1] > list_max(e) * 0.01) AS voiced FROM f),
        c AS (SELECT *, greatest(0, list_min(voiced) * 320 - 1600) AS a, least(len(x), (list_max(voiced) + 1) * 320 + 1600) AS b FROM v),
        t AS (SELECT s_suppkey, len(x) AS n_in, CASE WHEN b - a >= 16000 THEN x[a + 1:b] ELSE x END AS x FROM c)
        SELECT s_suppkey, n_in, len(x) AS n_out, round({_PEAK} * g, 9) AS peak, round(list_sum(x) * g, 6) AS total FROM (SELECT *, {_levelled('x')} AS g FROM t)""",
    "wav_duration": f"SELECT id, coalesce(seconds, -1.0) AS seconds FROM {WAV_SQL}",
    "shard_hashes": "SELECT id, md5(audio.bytes) AS audio_md5, duration FROM raw_clips",
}
