"""Queries of the text functions over raw_clips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.guards import residue
from corpusloom.plans import sqltext as Q


def clips(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/raw_clips.parquet")


def _each(columns: Callable[[Column], dict[str, Column]]):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        made = columns(F.col("text_raw"))
        return clips(spark, sf).select("id", *[c.alias(n) for n, c in made.items()])

    return query


def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf).select("id", T.null_safe(F.col("text_raw")).alias("text"), "duration")


def text_audit(spark: SparkSession, sf: str) -> DataFrame:
    t, n = T.null_safe(F.col("text_raw")), F.count(F.lit(1))
    arabic = F.count_if(T.has_arabic(t))
    return clips(spark, sf).agg(
        n.alias("n_rows"), arabic.alias("n_arabic"), F.count_if(T.has_digits(t)).alias("n_digits"), F.count_if(T.has_marks(t)).alias("n_marks"),
        (n - F.count_distinct(t)).alias("n_repeated"), F.round(F.try_divide(arabic * 100.0, n), 4).alias("pct_arabic"),
    )


def audio_keys(spark: SparkSession, sf: str) -> DataFrame:
    return clips(spark, sf).select("id", T.audio_key("audio").alias("audio_key"))


def normalize_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue(clips(spark, sf).select(T.Profile()(F.col("text_raw")).alias("t")), "t")


def _sizes(x: Column) -> dict[str, Column]:
    t = T.null_safe(x)
    return {"n_chars": T.char_count(t), "n_words": T.word_count(t), "short": T.is_short(t)}


QUERIES = {
    "scan_project": scan_project,
    "text_audit": text_audit,
    "text_normalize": _each(lambda x: {"persian": T.to_persian(x), "bare": T.without_marks(x), "collapsed": T.collapsed(x), "scoring": T.for_scoring(T.null_safe(x))}),
    "text_normalize_alt": _each(lambda x: {"extended": T.Profile(extended=True)(x), "unspelled": T.Profile(extended=True, spell_numbers=False)(x), "no_vowels": T.without_vowels(x), "no_spaces": T.without_spaces(x), "digits": T.to_persian_digits(x)}),
    "number_words": _each(lambda x: {"spelled": T.numbers_as_words(x), "normalized": T.Profile(collapse=False)(x)}),
    "fingerprint": _each(lambda x: {"letters": T.letters_only(x), "fingerprint": T.fingerprint(T.Profile()(x))}),
    "text_sizes": _each(_sizes),
    "audio_keys": audio_keys,
    "normalize_residue": normalize_residue,
}
_N = Q.null_safe("text_raw")
SQL = {
    "scan_project": f"SELECT id, {_N} AS text, duration FROM raw_clips",
    "text_audit": f"""SELECT count(*) AS n_rows, count(*) FILTER (regexp_matches({_N}, '[{T.ARABIC}]')) AS n_arabic, count(*) FILTER (regexp_matches({_N}, '\\p{{Nd}}')) AS n_digits,
        count(*) FILTER (regexp_matches({_N}, '[{T.MARKS}]')) AS n_marks, count(*) - count(DISTINCT {_N}) AS n_repeated,
        round(count(*) FILTER (regexp_matches({_N}, '[{T.ARABIC}]')) * 100.0 / count(*), 4)::DOUBLE AS pct_arabic FROM raw_clips""",
    "text_normalize": f"SELECT id, {Q.to_persian('text_raw')} AS persian, {Q.without_marks('text_raw')} AS bare, {Q.collapsed('text_raw')} AS collapsed, {Q.for_scoring(_N)} AS scoring FROM raw_clips",
    "text_normalize_alt": f"""SELECT id, {Q.extended('text_raw')} AS extended, {Q.extended('text_raw', False)} AS unspelled, {Q.rr('text_raw', f'[{T.VOWELS}]')} AS no_vowels, {Q.rr('text_raw', f'[{Q.S}' + r'\x{200C}]')} AS no_spaces,
        translate(text_raw, '{T.ARABIC + T.ASCII_DIGITS + T.ARABIC_DIGITS}', '{T.PERSIAN + T.PERSIAN_DIGITS * 2}') AS digits FROM raw_clips""",
    "number_words": f"WITH t AS (SELECT id, text_raw, {Q.to_persian(_N)} AS p FROM raw_clips) SELECT id, {Q.numwords.text_sql('text_raw')} AS spelled, {Q.numwords.text_sql('p')} AS normalized FROM t",
    "fingerprint": f"SELECT id, {Q.letters_only('text_raw')} AS letters, {Q.fingerprint(Q.normalized('text_raw'))} AS fingerprint FROM raw_clips",
    "text_sizes": f"SELECT id, length({_N})::INT AS n_chars, {Q.word_count(_N)}::INT AS n_words, {Q.is_short(_N)} AS short FROM raw_clips",
    "audio_keys": f"SELECT id, {Q.audio_key()} AS audio_key FROM raw_clips",
    "normalize_residue": f"SELECT count(*) FILTER (regexp_matches(t, '[{T.ARABIC}]')) AS n_arabic, count(*) FILTER (regexp_matches(t, '\\p{{Nd}}')) AS n_digits FROM (SELECT {Q.normalized('text_raw')} AS t FROM raw_clips)",
}
