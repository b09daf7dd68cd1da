"""Ranges, rates, summaries, histograms, error rates and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions import text as T
from corpusloom.functions import wav
from corpusloom.operators import guards, joins, metrics, report
from corpusloom.plans import sqltext as Q
from corpusloom.sources import sinks


def clips(spark: SparkSession, sf: str, name: str = "raw_clips") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_rates(clips(spark, sf, "train_clips").select("id", "duration", T.null_safe(F.col("cleaned_text")).alias("t")), "t", "duration").drop("t")


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf, "train_clips").select(T.word_count(T.null_safe(F.col("cleaned_text"))).alias("n_words"))


def figures(spark: SparkSession, sf: str) -> DataFrame:
    """Claimed figures of the clips against the measured ones; the claims are those of no size in particular."""
    df = clips(spark, sf).agg(F.count_if(F.col("duration") > 30.0).cast("double").alias("n_long"), F.max("duration").alias("longest"), F.count_if(F.col("text_raw").isNull()).cast("double").alias("n_null"))
    return guards.figure_check(df, {"n_long": (0, 0), "longest": (30, 0.01), "n_null": (0, 1000)})


#: Numbers of rows that the gate expects of the two splits.
EXPECTED = (32_000, 5_400)


def gate(spark: SparkSession, sf: str) -> DataFrame:
    train, val = (guards.table_if_present(spark, f"{sf}/{t}_clips.parquet") for t in ("train", "val"))
    return guards.quality_gate(train, val, "id", "cleaned_text", EXPECTED)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.density(clips(spark, sf), "duration", 60).select("bin", F.round("density", 9).alias("density"))


def undecodable() -> Column:
    return wav.plain_seconds(F.col("audio.bytes")).isNull()


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The clips that pass the decode gate, here with more failures allowed than its default, and only their key columns."""
    return joins.sanitized(metrics.drop_failed(clips(spark, sf), undecodable(), 0.05), ("id", "duration"))


def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The report as a text file, read back."""
    path = f"{runtime.shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    runtime._scratch.append((spark, path))
    sinks.write_report(report_of(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def blank_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error rates where every reference is empty."""
    return metrics.error_rates(clips(spark, sf, "train_clips").select(F.lit(" ،!").alias("r"), "cleaned_text"), "r", "cleaned_text")


def report_of(spark: SparkSession, sf: str) -> DataFrame:
    row = metrics.outliers(clips(spark, sf), "duration").drop("longest")
    return report.report_lines(row, {"n_rows": "Rows", "n_unreadable": "Unreadable", "n_short": "Shorter than 1 s", "n_long": "Longer than 30 s"})


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.error_rates(clips(spark, sf, "train_clips"), "cleaned_text", "text_raw")


QUERIES = {
    "range_filter": lambda spark, sf: clips(spark, sf).filter(metrics.in_range(F.col("duration"))).select("id", "duration"),
    "range_outliers": lambda spark, sf: metrics.outliers(clips(spark, sf), "duration"),
    "rate_metrics": rated,
    "rate_outliers": lambda spark, sf: metrics.rate_outliers(rated(spark, sf)),
    "summary_stats": lambda spark, sf: metrics.summary(clips(spark, sf), "duration"),
    "word_count_stats": lambda spark, sf: metrics.summary(lengths(spark, sf), "n_words"),
    "histogram": lambda spark, sf: metrics.histogram(clips(spark, sf), "duration", 60),
    "histogram_words": lambda spark, sf: metrics.histogram(lengths(spark, sf), "n_words", 50),
    "error_rates": errors,
    "decode_gate": lambda spark, sf: metrics.failure_rate(clips(spark, sf), undecodable()),
    "decode_kept": decoded,
    "density": dense,
    "error_rates_blank": blank_errors,
    "report_file": report_file,
    "quality_gate": gate,
    "figure_check": figures,
    "report_lines": report_of,
    "storage_estimate": lambda spark, sf: metrics.storage(clips(spark, sf, "train_clips"), free_gb=10.0),
}

_T = "coalesce(cleaned_text, '')"
_RATED = f"SELECT id, duration, {Q.word_count(_T)}::INT AS word_count, length({_T})::INT AS char_count FROM train_clips"
_WORDS = f"(SELECT {Q.word_count(_T)}::DOUBLE AS v FROM train_clips)"
_SECONDS = "(SELECT duration AS v FROM raw_clips)"


def _summary(src: str) -> str:
    return f"SELECT count(v) AS n, round(avg(v), 6) AS mean, median(v) AS median, max(v) AS max, min(v) AS min FROM {src}"


def _histogram(src: str, bins: int) -> str:
    return f"""WITH v AS (SELECT v FROM {src} WHERE v IS NOT NULL), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
        b AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS INT), {bins - 1}) AS bin, count(*) AS n FROM v, m GROUP BY 1)
        SELECT CAST(r.range AS INT) AS bin, coalesce(b.n, 0) AS n FROM range({bins}) r LEFT JOIN b ON b.bin = r.range"""


def _encoded(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda s: chr(33 + CAST(list_position(v, s) AS INT))), '')"


#: Rows with the seconds by header, null where the clip is corrupt.
WAV_SQL = f"(SELECT id, duration, {Q.wav_seconds('h')} AS seconds FROM (SELECT id, duration, hex(audio.bytes) AS h FROM raw_clips))"

_REPORT = """WITH r AS (SELECT count(*) AS a, count(*) FILTER (duration IS NULL) AS b, count(*) FILTER (duration < 1.0) AS c, count(*) FILTER (duration > 30.0) AS d FROM raw_clips)
        SELECT {0} 'Rows: ' || a AS line FROM r UNION ALL SELECT {1} 'Unreadable: ' || b FROM r UNION ALL SELECT {2} 'Shorter than 1 s: ' || c FROM r UNION ALL SELECT {3} 'Longer than 30 s: ' || d FROM r"""

SQL = {
    "range_filter": "SELECT id, duration FROM raw_clips WHERE duration BETWEEN 1.0 AND 30.0",
    "range_outliers": "SELECT count(*) AS n_rows, count(*) FILTER (duration IS NULL) AS n_unreadable, count(*) FILTER (duration < 1.0) AS n_short, count(*) FILTER (duration > 30.0) AS n_long, max(duration) AS longest FROM raw_clips",
    "rate_metrics": f"SELECT *, word_count / nullif(duration, 0) AS wps, char_count / nullif(duration, 0) AS cps FROM ({_RATED})",
    "rate_outliers": f"""SELECT count(*) AS n_rows, count(*) FILTER (wps > 5.0) AS n_fast, count(*) FILTER (cps < 8.0) AS n_slow, count(*) FILTER (wps > 5.0 OR cps < 8.0) AS n_either,
        round(count(*) FILTER (wps > 5.0) * 100.0::DOUBLE / count(*), 2) AS pct_fast, round(count(*) FILTER (cps < 8.0) * 100.0::DOUBLE / count(*), 2) AS pct_slow, round(count(*) FILTER (wps > 5.0 OR cps < 8.0) * 100.0::DOUBLE / count(*), 2) AS pct_either
        FROM (SELECT *, word_count / nullif(duration, 0) AS wps, char_count / nullif(duration, 0) AS cps FROM ({_RATED}))""",
    "summary_stats": _summary(_SECONDS),
    "word_count_stats": _summary(_WORDS),
    "histogram": _histogram(_SECONDS, 60),
    "histogram_words": _histogram(_WORDS, 50),
    "error_rates": f"""WITH t AS (SELECT {Q.for_scoring(_T)} AS r, {Q.for_scoring("coalesce(text_raw, '')")} AS p FROM train_clips),
        c AS (SELECT r, p, regexp_extract_all(r, '(?s).') AS rc, regexp_extract_all(p, '(?s).') AS pc, {Q.words('r')} AS rw, {Q.words('p')} AS pw FROM t),
        d AS (SELECT *, list_distinct(list_concat(rc, pc)) AS vc, list_distinct(list_concat(rw, pw)) AS vw FROM c),
        e AS (SELECT r <> '' AS use, len(rw) AS wn, len(rc) AS cn, (SELECT levenshtein({_encoded('rc')}, {_encoded('pc')}) FROM (SELECT vc AS v)) AS ce, (SELECT levenshtein({_encoded('rw')}, {_encoded('pw')}) FROM (SELECT vw AS v)) AS we FROM d)
        SELECT count(*) AS n_pairs, count(*) FILTER (NOT use) AS n_dropped, (sum(we) FILTER (use))::BIGINT AS word_edits, (sum(wn) FILTER (use))::BIGINT AS words, (sum(ce) FILTER (use))::BIGINT AS char_edits, (sum(cn) FILTER (use))::BIGINT AS chars,
        round(sum(we) FILTER (use) * 100.0::DOUBLE / sum(wn) FILTER (use), 2) AS wer, round(sum(ce) FILTER (use) * 100.0::DOUBLE / sum(cn) FILTER (use), 2) AS cer FROM e""",
    "decode_gate": f"SELECT count(*) AS n_before, count(*) FILTER (seconds IS NULL) AS n_failed, count(*) FILTER (seconds IS NULL)::DOUBLE / count(*) AS rate, count(*) FILTER (seconds IS NULL)::DOUBLE / count(*) > 0.005 AS aborts FROM {WAV_SQL}",
    "quality_gate": f"""WITH b AS (SELECT id, {_T} AS t FROM train_clips UNION ALL SELECT id, {_T} FROM val_clips), c AS (
        SELECT 'empty_train' AS "check", CASE WHEN (SELECT count(*) FROM train_clips) = 0 THEN 1 ELSE 0 END AS n_bad UNION ALL SELECT 'empty_val', CASE WHEN (SELECT count(*) FROM val_clips) = 0 THEN 1 ELSE 0 END
        UNION ALL SELECT 'missing_train', 0 UNION ALL SELECT 'missing_val', 0 UNION ALL SELECT 'train_rows_off', abs((SELECT count(*) FROM train_clips) - {EXPECTED[0]}) UNION ALL SELECT 'val_rows_off', abs((SELECT count(*) FROM val_clips) - {EXPECTED[1]})
        UNION ALL SELECT 'repeated_train_ids', (SELECT count(*) - count(DISTINCT id) FROM train_clips) UNION ALL SELECT 'repeated_val_ids', (SELECT count(*) - count(DISTINCT id) FROM val_clips)
        UNION ALL SELECT 'overlapping_ids', (SELECT count(*) FROM (SELECT id FROM train_clips INTERSECT SELECT id FROM val_clips))
        UNION ALL SELECT 'arabic_letters', (SELECT count(*) FROM b WHERE regexp_matches(t, '[{T.ARABIC}]')) UNION ALL SELECT 'digits', (SELECT count(*) FROM b WHERE regexp_matches(t, '\\p{{Nd}}'))
        UNION ALL SELECT 'blank_labels', (SELECT count(*) FROM b WHERE {Q.collapsed('t')} = '')) SELECT "check", n_bad::BIGINT AS n_bad, n_bad = 0 AS ok FROM c""",
    "figure_check": """WITH f AS (SELECT count(*) FILTER (duration > 30.0)::DOUBLE AS n_long, max(duration) AS longest, count(*) FILTER (text_raw IS NULL)::DOUBLE AS n_null FROM raw_clips),
        u AS (SELECT 'n_long' AS metric, n_long AS actual, 0.0::DOUBLE AS expected, 0.0::DOUBLE AS tolerance FROM f UNION ALL SELECT 'longest', longest, 30.0, 0.01 FROM f UNION ALL SELECT 'n_null', n_null, 0.0, 1000.0 FROM f)
        SELECT *, abs(actual - expected) <= tolerance AS ok FROM u""",
    "report_lines": _REPORT.format("1 AS line_no,", "2,", "3,", "4,"),
    "report_file": _REPORT.format("", "", "", ""),
    "decode_kept": f"SELECT id, duration FROM {WAV_SQL} WHERE seconds IS NOT NULL",
    "density": f"""WITH h AS ({_histogram(_SECONDS, 60)}), s AS (SELECT count(v) AS n, (max(v) - min(v)) / 60 AS step, stddev_samp(v) * count(v) ** -0.2 AS w FROM {_SECONDS})
        SELECT a.bin, round(sum(b.n * exp(-(((a.bin - b.bin) * step / w) ** 2) / 2)) / any_value(s.n * w) / sqrt(2 * pi()), 9) AS density FROM h a, h b, s GROUP BY 1""",
    "error_rates_blank": "SELECT count(*) AS n_pairs, count(*) AS n_dropped, 0::BIGINT AS word_edits, 0::BIGINT AS words, 0::BIGINT AS char_edits, 0::BIGINT AS chars, 0.0::DOUBLE AS wer, 0.0::DOUBLE AS cer FROM train_clips",
    "storage_estimate": "SELECT count(*) AS n_rows, count(*) * (128 * 3000 * 4)::DOUBLE / 1e9 AS gb, count(*) * (128 * 3000 * 4)::DOUBLE / 1e9 * 1.15 AS gb_with_reserve, 10.0 >= count(*) * (128 * 3000 * 4)::DOUBLE / 1e9 * 1.15 AS fits FROM train_clips",
}
