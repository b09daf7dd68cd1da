"""Exact duplicates, fingerprint cap and their counts, without ever gathering a group.

``order`` is a column that defines "first"; rows equal in it must be equal in all else. First rows come from
``min_by`` aggregates (combined before the shuffle); the first three of a group from a rank filter that Spark
limits per group before the shuffle. A group that holds a third of all rows therefore costs no single task more
than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.operators.skew import join_per_key

CAP, KEY = 3, "__key"


def exact_dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each combination of ``keys``; nulls are equal to each other. The keys are shuffled
    as one digest."""
    parts = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("")) for c in keys]
    first = df.groupBy(F.unhex(F.md5(F.concat_ws(",", *parts))).alias("__key")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__row"))
    return first.select("__row.*")


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """One row: rows beyond the first of their key."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("n_duplicates"))


def groups(df: DataFrame, key: str, text: str, order: str, short: Column | None = None) -> DataFrame:
    """(key, n, first_text, short): size of each group and whether its first row's text is short."""
    from corpusloom.functions.text import is_short

    first = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(text, order).alias("first_text"))
    return first.withColumn("short", is_short(F.col("first_text")) if short is None else short)


def capped(df: DataFrame, key: str, text: str, order: str, cap: int = CAP) -> DataFrame:
    """Groups whose first text is short keep all rows, the others their first ``cap``. ``df`` is evaluated once."""
    rows = runtime.table(df.withColumn(KEY, F.coalesce(F.unhex(F.md5(F.col(key).cast("string"))), F.unhex(F.lit("00")))))  # null is a group too
    own = runtime.table(groups(rows, KEY, text, order).select(KEY, "n", "short"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(order))
    first = rows.withColumn("__rank", rank).filter(F.col("__rank") <= cap).drop("__rank")
    kept_long = first.join(own.filter("NOT short").select(KEY), KEY, "left_semi")
    kept_short = join_per_key(rows, own.filter("short").drop("short"), [KEY], "n", F.col(order))
    return kept_short.select(*df.columns).unionByName(kept_long.select(*df.columns))


def excess_count(df: DataFrame, key: str, text: str, order: str, cap: int = CAP) -> DataFrame:
    """One row: groups over the cap and rows beyond it."""
    own = groups(df, key, text, order).filter(~F.col("short") & (F.col("n") > cap))
    return own.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - cap), F.lit(0)).alias("n_excess"))


def breakdown(df: DataFrame, key: str, text: str, order: str, cap: int = CAP) -> DataFrame:
    """(kind, n_rows, n_texts) for repeated groups: short ones kept, long ones within the cap, over it kept, dropped."""
    own = groups(df, key, text, order).filter("n > 1")
    kinds = F.array(
        F.struct(F.lit("short_kept").alias("kind"), F.when(F.col("short"), F.col("n")).alias("rows")),
        F.struct(F.lit("long_within_cap").alias("kind"), F.when(~F.col("short") & (F.col("n") <= cap), F.col("n")).alias("rows")),
        F.struct(F.lit("long_over_cap_kept").alias("kind"), F.when(~F.col("short") & (F.col("n") > cap), F.lit(cap).cast("bigint")).alias("rows")),
        F.struct(F.lit("long_over_cap_dropped").alias("kind"), F.when(~F.col("short") & (F.col("n") > cap), F.col("n") - cap).alias("rows")),
    )
    return own.select(F.explode(kinds).alias("k")).groupBy("k.kind").agg(F.coalesce(F.sum("k.rows"), F.lit(0)).alias("n_rows"), F.count("k.rows").alias("n_texts"))


def frequencies(df: DataFrame, key: str, above: int = 1) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > above)
