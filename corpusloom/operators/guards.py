"""Data-quality checks as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.report import unpivoted


def figure_check(actual: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """(metric, actual, expected, tolerance, ok) for a one-row frame of figures."""
    rows = unpivoted(actual)
    claims = F.create_map(*[x for k, (e, t) in expected.items() for x in (F.lit(k), F.struct(F.lit(float(e)).alias("e"), F.lit(float(t)).alias("t")))])
    claim = F.try_element_at(claims, F.col("metric"))
    return rows.filter(F.col("metric").isin(list(expected))).select("metric", F.col("value").alias("actual"), claim["e"].alias("expected"), claim["t"].alias("tolerance"), F.coalesce(F.abs(F.col("value") - claim["e"]) <= claim["t"], F.lit(False)).alias("ok"))


def residue(df: DataFrame, text: str) -> DataFrame:
    """One row: texts that still have letters or digits that normalising should have removed."""
    t = T.null_safe(F.col(text))
    return df.agg(F.count_if(T.has_arabic(t)).alias("n_arabic"), F.count_if(T.has_digits(t)).alias("n_digits"))


def quality_gate(train: DataFrame | None, val: DataFrame | None, key: str, text: str, expected: tuple[int, int] | None = None) -> DataFrame:
    """(check, n_bad, ok) of both splits together: present and not empty, the expected numbers of rows, unique keys, no
    overlap, no foreign letters, no digits, no blanks.

    A split that is None is missing and counts as empty. ``expected``: rows of train and val; n_bad is how far off
    they are, and without ``expected`` nothing. Null keys count as one key. One aggregate per key carries all checks,
    so rows are shuffled once and only as one number per key and task.
    """
    here = {s: d for s, d in (("t", train), ("v", val)) if d is not None}
    if not here:
        raise ValueError("neither split is there")
    both = reduce(DataFrame.unionByName, [d.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(s).alias("s")) for s, d in here.items()])
    t = T.null_safe(F.col("t"))
    flags = {"n_train": F.col("s") == "t", "n_val": F.col("s") == "v", "arabic_letters": T.has_arabic(t), "digits": T.has_digits(t), "blank_labels": F.trim(T.collapsed(t)) == ""}
    per_key = both.groupBy("k").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    repeated = lambda n: whole(F.greatest(F.col(n) - 1, F.lit(0)))
    sums = per_key.agg(
        *[whole(n).alias(n) for n in flags],
        repeated("n_train").alias("repeated_train_ids"), repeated("n_val").alias("repeated_val_ids"),
        F.count_if((F.col("n_train") > 0) & (F.col("n_val") > 0)).alias("overlapping_ids"),
    )
    off = lambda n, i: (F.abs(F.col(n) - expected[i]) if expected else F.lit(0)).cast("bigint")
    empty = lambda n: (F.col(n) == 0).cast("bigint")
    missing = lambda s: F.lit(int(s not in here)).cast("bigint")
    row = sums.select(
        missing("t").alias("missing_train"), missing("v").alias("missing_val"), empty("n_train").alias("empty_train"), empty("n_val").alias("empty_val"),
        off("n_train", 0).alias("train_rows_off"), off("n_val", 1).alias("val_rows_off"),
        "repeated_train_ids", "repeated_val_ids", "overlapping_ids", "arabic_letters", "digits", "blank_labels",
    )
    return unpivoted(row, kind="bigint").select(F.col("metric").alias("check"), F.col("value").alias("n_bad"), (F.col("value") == 0).alias("ok"))


def table_if_present(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.format(form).load(path)
