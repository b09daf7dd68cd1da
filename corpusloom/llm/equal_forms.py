"""Texts that look the same but are stored differently (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.arrow import with_columns
from corpusloom.llm.forms import letters, shape
from corpusloom.llm.lookalikes import latin_words, repair
from corpusloom.operators.skew import join_per_key, join_spread

MIN_LETTERS = 15


def _shapes(values: list) -> list:
    return [shape(v) for v in values]


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the stored text, shape and number of letters and digits; each text is shaped once."""
    for b in batches:
        forms = [shape(v) for v in b.column("stored").to_pylist()]
        n = pa.array([len(letters(f)) for f in forms], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("s"), n, pa.array(forms, pa.string())], ["id", "s", "n", "form"])


def consistent(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` plus the consistent form of ``text``: shape of each text, then look-alike repair against the
    vocabulary of the whole column. Null texts have a null form, empty and blank ones "". All rows are kept;
    an existing column ``out`` is replaced."""
    shaped = runtime.table(with_columns(df.drop(out), {out: ("string", _shapes)}, text))
    return repair(shaped, out, latin_words(shaped, out))


def varied_members(df: DataFrame, key: str, text: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, s, k): digests of the stored text and of its form, of the records whose form is stored in several ways."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("stored"), F.unhex(F.md5(F.col(text))).alias("s")).filter("id IS NOT NULL AND stored IS NOT NULL")
    shaped = runtime.table(rows.mapInArrow(_shaped, "id bigint, s binary, n int, form string"))
    same = repair(shaped, "form", latin_words(shaped, "form")).filter(F.col("n") >= min_letters)
    same = runtime.table(same.select("id", "s", F.unhex(F.md5("form")).alias("k")).distinct())
    varied = same.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("k", "n")
    members = runtime.table(join_per_key(same, runtime.table(varied), ["k"], "n", F.col("id")).select("id", "s", "k"))
    runtime.release(shaped, same)
    return members


def look_same_pairs(df: DataFrame, key: str, text: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id_a, id_b): pairs of different ids, smaller first, whose texts differ as stored but look the same.

    Null ids or texts and texts of fewer than ``min_letters`` letters and digits take no part; a row repeated
    whole counts once; an empty table gives no rows. Only ids and 16-byte digests are shuffled. The pairs of a
    class are as many as the result asks for; :func:`look_same_classes` gives one row per record instead.
    """
    members = varied_members(df, key, text, min_letters)
    a, b = members.toDF("id_a", "s_a", "k"), members.toDF("id_b", "s_b", "k")
    return join_spread(a, b, ["k"], F.col("id_a")).filter("id_a < id_b AND s_a <> s_b").select("id_a", "id_b").distinct()


def look_same_classes(df: DataFrame, key: str, text: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, class_id, n_links): one row for each record that looks like another one stored differently: the smallest id
    of its class, and the number of other records' stored texts in it that differ from its own. A record stored in
    several ways counts as often. Nothing in a class is paired."""
    members = varied_members(df, key, text, min_letters)
    per = members.groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    alike = members.groupBy("k", "s").agg(F.count(F.lit(1)).alias("alike"))
    counted = runtime.table(alike.join(per, "k").select("k", "s", "class_id", (F.col("n") - F.col("alike")).alias("n_links"), "alike"))
    out = join_per_key(members, counted, ["k", "s"], "alike", F.col("id"))
    return out.groupBy("id", "class_id").agg(F.sum("n_links").alias("n_links"))


def form_report(df: DataFrame, text: str) -> DataFrame:
    """One row: texts, distinct stored texts, distinct consistent forms, texts changed by the form."""
    rows = consistent(df.select(F.col(text).alias("stored")), "stored")
    return rows.agg(
        F.count("stored").alias("n_texts"),
        F.countDistinct(F.md5("stored")).alias("n_stored"),
        F.countDistinct(F.md5("form")).alias("n_forms"),
        F.count_if(F.col("form") != F.col("stored")).alias("n_changed"),
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_same_pairs(spark.read.parquet(f"{sf}/raw_clips.parquet"), "id", "text_raw")


def p2_form_report(spark: SparkSession, sf: str) -> DataFrame:
    return form_report(spark.read.parquet(f"{sf}/raw_clips.parquet"), "text_raw")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return look_same_classes(spark.read.parquet(f"{sf}/raw_clips.parquet"), "id", "text_raw")


QUERIES = {"p2_found": p2_found, "p2_form_report": p2_form_report, "p2_classes": p2_classes}
SQL: dict[str, str] = {}
