"""Rates, summaries, histograms, error rates, gates and run-time figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SHORTEST, LONGEST = 1.0, 30.0
FAST_WORDS, SLOW_CHARS = 5.0, 8.0
MAX_FAILED = 0.005


def known(seconds: Column) -> Column:
    """NaN is as unknown as null: it is below and above nothing."""
    return F.when(~F.isnan(seconds), seconds)


def in_range(seconds: Column, low: float = SHORTEST, high: float = LONGEST) -> Column:
    """A plain comparison, so that it reaches the scan; NaN orders above ``high`` and is out like null."""
    return seconds.between(low, high)


def outliers(df: DataFrame, seconds: str) -> DataFrame:
    """One row: rows, unreadable, below and above the range, the longest."""
    s = known(F.col(seconds))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(s.isNull()).alias("n_unreadable"), F.count_if(s < SHORTEST).alias("n_short"), F.count_if(s > LONGEST).alias("n_long"), F.max(s).alias("longest"))


def with_rates(df: DataFrame, text: str, seconds: str) -> DataFrame:
    s = known(F.col(seconds))
    return df.withColumns({"word_count": T.word_count(F.col(text)), "char_count": T.char_count(F.col(text))}).withColumns({"wps": F.try_divide("word_count", s), "cps": F.try_divide("char_count", s)})


def fast(wps: Column) -> Column:
    return wps > FAST_WORDS


def slow(cps: Column) -> Column:
    return cps < SLOW_CHARS


def rate_outliers(rated: DataFrame) -> DataFrame:
    """Counts and percentages of rows over the word rate, under the character rate, or either."""
    f, s = F.coalesce(fast(F.col("wps")), F.lit(False)), F.coalesce(slow(F.col("cps")), F.lit(False))
    n = F.count(F.lit(1))
    pct = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c) * 100.0, n), 2), F.lit(0.0))
    return rated.agg(n.alias("n_rows"), F.count_if(f).alias("n_fast"), F.count_if(s).alias("n_slow"), F.count_if(f | s).alias("n_either"), pct(f).alias("pct_fast"), pct(s).alias("pct_slow"), pct(f | s).alias("pct_either"))


def value_at(df: DataFrame, value: str, rank: int, few: int = 10_000, bins: int = 1024) -> float | None:
    """The value of this 1-based rank among the known ones, exactly; None where there are fewer. Each pass counts
    ``bins`` equal ranges and goes on with the one that holds the rank, until at most ``few`` rows or one value are
    left: no task and no driver ever holds more."""
    v = known(F.col(value).cast("double"))
    rows = df.select(v.alias("v")).filter("v IS NOT NULL")
    n, lo, hi = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not 1 <= rank <= n:
        return None
    while lo < hi:
        here = rows.filter(F.col("v").between(lo, hi))
        if n <= few:
            return here.orderBy("v").limit(rank).agg(F.max("v")).first()[0]
        at = F.floor((F.col("v") - lo) / ((hi - lo) / bins))
        for r in sorted(here.groupBy(at.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
            if rank <= r.n:
                n, lo, hi = r.n, r.lo, r.hi
                break
            rank -= r.n
    return lo


def median(df: DataFrame, value: str) -> float | None:
    """The exact median; the mean of the two middle values where their number is even. None without known values."""
    v = known(F.col(value).cast("double"))
    n = df.agg(F.count(v)).first()[0]
    if not n:
        return None
    low = value_at(df, value, (n + 1) // 2)
    if n % 2:
        return low
    upto, above = df.agg(F.count_if(v <= low), F.min(F.when(v > low, v))).first()
    return low if upto >= n // 2 + 1 else (low + above) / 2


def summary(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, exact median, largest and least value."""
    v = known(F.col(value).cast("double"))
    return df.agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.lit(median(df, value)).cast("double").alias("median"), F.max(v).alias("max"), F.min(v).alias("min"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of ``bins`` equal widths from the least to the largest value; the last bin holds both its ends."""
    v = known(F.col(value).cast("double"))
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    spark = df.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return every.select("bin", F.lit(0).cast("bigint").alias("n"))
    width = (hi - lo) / bins
    at = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    counts = df.filter(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, value: str, bins: int, width: float | None = None) -> DataFrame:
    """(bin, density): a Gaussian kernel density at the middle of each bin of :func:`histogram`, from the bins' counts.
    ``width`` of the kernel: by default the standard deviation times n ** -0.2. Without a spread there are no rows."""
    v = known(F.col(value).cast("double"))
    n, lo, hi, spread = df.agg(F.count(v), F.min(v), F.max(v), F.stddev(v)).first()
    if not n or hi <= lo:
        return df.sparkSession.createDataFrame([], "bin int, density double")
    width = width or spread * n**-0.2
    counts = histogram(df, value, bins)  # as many rows as bins
    step = (hi - lo) / bins
    far = (F.col("bin") - F.col("other")) * step / width
    pairs = F.broadcast(counts.select(F.col("bin").alias("other"), F.col("n").alias("held")))
    pairs = counts.select("bin").join(pairs, how="cross")
    return pairs.groupBy("bin").agg((F.sum(F.col("held") * F.exp(-far * far / 2)) / (n * width * (2 * math.pi) ** 0.5)).alias("density"))


# --- error rates ---


def _symbols(own: Column, all_: Column) -> Column:
    """Each word as one code point, by its place in the pair's vocabulary; surrogates are passed over. An error beyond the last code point."""

    def symbol(w: Column) -> Column:
        at = F.lit(19968) + F.array_position(all_, w)
        at = F.when(at < 0xD800, at).otherwise(at + 0x800)
        at = F.when(at <= 0x10FFFF, at).otherwise(F.raise_error(F.lit("too many different words in a pair")).cast("bigint"))
        return F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32")

    return F.array_join(F.transform(own, symbol), "")


def word_edits(reference: Column, prediction: Column) -> Column:
    """Word-level edit distance (an error beyond 1,092,095 different words in a pair)."""
    r, p = T.words(reference), T.words(prediction)
    return F.transform(F.array(F.struct(r.alias("r"), p.alias("p"), F.array_distinct(F.concat(r, p)).alias("v"))), lambda x: F.levenshtein(_symbols(x["r"], x["v"]), _symbols(x["p"], x["v"])))[0]


def error_rates(pairs: DataFrame, reference: str, prediction: str) -> DataFrame:
    """One row: pairs, pairs dropped for an empty reference, corpus word and character error rates in percent.

    Both texts are brought to the scoring form. Null predictions count as empty; null references as empty ones.
    With no usable pair both rates are 0.
    """
    norm = pairs.select(T.for_scoring(T.null_safe(F.col(reference))).alias("r"), T.for_scoring(T.null_safe(F.col(prediction))).alias("p"))
    use = F.col("r") != ""
    each = norm.select(use.alias("use"), F.when(use, word_edits(F.col("r"), F.col("p"))).alias("we"), F.when(use, T.word_count(F.col("r"))).alias("wn"), F.when(use, F.levenshtein("r", "p")).alias("ce"), F.when(use, F.length("r")).alias("cn"))
    rate = lambda e, n: F.coalesce(F.round(F.try_divide(F.sum(e) * 100.0, F.sum(n)), 2), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return each.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("use")).alias("n_dropped"), total("we").alias("word_edits"), total("wn").alias("words"), total("ce").alias("char_edits"), total("cn").alias("chars"), rate("we", "wn").alias("wer"), rate("ce", "cn").alias("cer"))


# --- gates and estimates ---


def failure_rate(df: DataFrame, failed: Column, most: float = MAX_FAILED) -> DataFrame:
    """One row: rows, failures, their rate, and whether that is more than ``most``."""
    rate = F.coalesce(F.try_divide(F.count_if(failed).cast("double"), F.count(F.lit(1))), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(failed).alias("n_failed"), rate.alias("rate"), (rate > most).alias("aborts"))


def drop_failed(df: DataFrame, failed: Column, most: float = MAX_FAILED) -> DataFrame:
    """Without the failed rows; an error when they are more than ``most`` of all."""
    from corpusloom.operators.joins import DataError

    row = failure_rate(df, failed, most).first()
    if row.aborts:
        raise DataError(f"{row.n_failed} of {row.n_before} rows failed, more than {most:.2%}")
    return df.filter(~failed) if row.n_failed else df


def storage(df: DataFrame, values: int = 128 * 3000, width: int = 4, free_gb: float | None = None) -> DataFrame:
    """One row: rows and GB of a cache of ``values`` numbers of ``width`` bytes a row, with a 15 % reserve, and whether
    that is within ``free_gb`` (null where it is not given)."""
    gb = F.count(F.lit(1)) * float(values * width) / 1e9
    fits = F.lit(free_gb).cast("double") >= gb * 1.15
    return df.agg(F.count(F.lit(1)).alias("n_rows"), gb.alias("gb"), (gb * 1.15).alias("gb_with_reserve"), fits.alias("fits"))


def run_times(results: DataFrame, steps: int, samples: int) -> DataFrame:
    """Seconds a step and an evaluated sample from total and evaluation times; both null where either is missing."""
    both = F.col("train_runtime").isNotNull() & F.col("eval_runtime").isNotNull()
    return results.withColumns({"s_per_step": F.when(both, F.try_divide(F.col("train_runtime") - F.col("eval_runtime"), F.lit(steps))), "s_per_eval_sample": F.when(both, F.try_divide("eval_runtime", F.lit(samples)))})


def against_baseline(results: DataFrame, baseline: str, steps: int, reference: float | None = None) -> DataFrame:
    """Speed-up over the named row, hours for ``steps`` steps, and the hours where the named row takes ``reference``
    seconds a step; null where a figure is missing."""
    base = results.filter((F.col("name") == baseline) & (F.col("s_per_step") != 0)).agg(F.max("s_per_step").alias("base"))
    out = results.join(F.broadcast(base), how="cross")
    speedup = F.try_divide("base", F.col("s_per_step"))
    return out.withColumns({"speedup": speedup, "hours": F.col("s_per_step") * steps / 3600.0, "reference_hours": F.try_divide(F.lit(reference).cast("double"), speedup) * steps / 3600.0}).drop("base")


def chosen(results: DataFrame, names: str) -> DataFrame:
    """The rows whose ``name`` is in the comma-separated list ``names``; an unknown name is an error."""
    from corpusloom.operators.joins import DataError

    wanted = [n.strip() for n in names.split(",")]
    known_ = {r.name for r in results.filter(F.col("name").isin(wanted)).select("name").distinct().collect()}  # at most as many as asked for
    if missing := [n for n in wanted if n not in known_]:
        raise DataError(f"unknown names: {', '.join(missing)}")
    return results.filter(F.col("name").isin(wanted))
