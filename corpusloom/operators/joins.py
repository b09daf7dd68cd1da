"""Label joins with coverage and leakage guards, and set operations on ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """Input that must not be used: missing columns, leaked ids, failed coverage, failed gates."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(labels: DataFrame, key: str = "id") -> DataFrame:
    twice = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(key).limit(5).collect()
    if twice:
        raise DataError(f"repeated {key}: {[r[0] for r in twice]}")
    return labels


def attach(rows: DataFrame, labels: DataFrame, key: str = "id", columns: tuple[str, ...] = ("cleaned_text",), unique: bool = True) -> DataFrame:
    """Inner join by ``key``. A key with several rows of ``labels`` is an error, so that no row is multiplied; ``unique``
    false skips that check for labels known to have one row per key. Null keys match nothing."""
    require_columns(labels, key, *columns)
    if unique:
        require_unique(labels.filter(F.col(key).isNotNull()), key)
    return rows.join(labels.select(key, *columns), key)


def sanitized(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Only the columns of ``keep``, in that order; one that is missing is an error."""
    return require_columns(df, *keep).select(*keep)


def routed(rows: DataFrame, splits: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """``rows`` plus ``split``: the first of ``splits`` that has the key, or 'unused'."""
    ranked = reduce(DataFrame.unionByName, [d.select(key, F.lit(i).alias("__i")) for i, d in enumerate(splits.values())])
    first = ranked.groupBy(key).agg(F.min("__i").alias("__i"))
    names = F.array(*[F.lit(s) for s in splits])
    return rows.join(first, key, "left").withColumn("split", F.coalesce(F.get(names, F.col("__i")), F.lit("unused"))).drop("__i")


def unmatched(labels: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return labels.join(rows.select(key), key, "left_anti")


def coverage(labels: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """One row: labels, labels without a row, and whether all, some or none have one ('all' of no labels)."""
    there = rows.select(key).distinct().withColumn("__there", F.lit(1))
    found = labels.select(key).join(there, key, "left")
    n, missing = F.count(F.lit(1)), F.count_if(F.col("__there").isNull())
    return found.agg(n.alias("n_labels"), missing.alias("n_missing"), F.when(missing == 0, "all").when(missing == n, "none").otherwise("some").alias("covered"))


def check_coverage(labels: DataFrame, rows: DataFrame, key: str = "id", partial: bool = False) -> int:
    """Number of labels without a row. All missing is an error; some missing too, unless ``partial``."""
    r = coverage(labels, rows, key).first()
    if r.covered == "none":
        raise DataError("no label matches a row")
    if r.n_missing and not partial:
        raise DataError(f"{r.n_missing} of {r.n_labels} labels match no row")
    return r.n_missing


def leaked(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def check_no_leakage(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    some = leaked(a, b, key).orderBy(key).limit(5).collect()
    if some:
        raise DataError(f"ids in both splits, such as {[r[0] for r in some]}")


def id_union(*tables: DataFrame, key: str = "id") -> DataFrame:
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct()


def stacked(*tables: DataFrame) -> DataFrame:
    """Union of all rows by column name."""
    return reduce(lambda x, y: x.unionByName(y), tables)


def difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).subtract(b.select(key))


def check_not_empty(**splits: DataFrame) -> None:
    empty = [n for n, d in splits.items() if d.isEmpty()]
    if empty:
        raise DataError(f"no rows in {', '.join(empty)}")
