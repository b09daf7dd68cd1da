"""Word sets of texts as vectors over word hashes, in one global order, rare words first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.forms import VOWELS
from corpusloom.operators.skew import join_per_key

#: Words are ordered by frequency only when they make up at least 1/FREQUENT of all word occurrences; so at most
#: FREQUENT of them are sent to the executors, however large the vocabulary. Rarer words come first, by hash.
FREQUENT = 50_000
ZERO_WIDTH = rf"[{VOWELS}\p{{Cf}}]"


def words(text: Column) -> Column:
    """The different words of a text: vowel marks and zero-width characters dropped, lower case, split at all that
    is no letter or digit."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, ZERO_WIDTH, "")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def members(df: DataFrame, key: str, text: str, min_words: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, k, w): records of at least ``min_words`` different words; ``w`` their sorted 64-bit hashes, ``k`` a digest of ``w``."""
    rows = df.select(F.col(key).alias("id"), *extra, F.array_sort(F.transform(words(F.col(text)), lambda w: F.xxhash64(w))).alias("w"))
    rows = rows.filter((F.size("w") >= min_words) & F.col("id").isNotNull())
    return rows.withColumn("k", F.unhex(F.md5(F.concat_ws(",", F.transform("w", lambda x: x.cast("string"))))))


def frequent(classes: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts, number of classes): the words that hold at least 1/most of all occurrences, so at most ``most``."""
    counted = classes.select(F.explode("w").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    n, all_ = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    rows = counted.filter(F.col("df") >= max(1.0, all_ / most)).toPandas()
    rows = rows.sort_values("h")
    return rows.h.to_numpy(np.int64), rows.df.to_numpy(np.int64), n


class Order:
    """The global order of words, and their weights. ``ratio``: how much more the square of the heaviest weight is than
    that of the lightest; 1 for equal weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, ratio: float = 1.0):
        if ratio < 1:
            raise ValueError("the ratio of the weights must be at least 1")
        self.hashes, self.counts, self.n, self.ratio = hashes, counts, n, ratio
        self.least = max(1.0, counts.min() if len(counts) else 1.0)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Position of each word among the frequent ones, their number for all others."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def counts_of(self, h: np.ndarray) -> np.ndarray:
        """Occurrences of each word, 0 for the rare ones."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)

    def weights_of(self, counts: np.ndarray) -> np.ndarray:
        """Weights whose square goes from 1 to ``ratio`` with the inverse document frequency; rare words count like the
        rarest frequent one."""
        if self.ratio == 1:
            return np.ones(len(counts))
        idf = np.log1p(self.n / np.maximum(counts, self.least)) / np.log1p(self.n / self.least)
        return np.sqrt(1 + (self.ratio - 1) * np.minimum(idf, 1.0))

    def sort(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, weights of unit length) of each segment in the global order."""
        counts = self.counts_of(flat)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        by = np.lexsort((flat, counts, owner))
        w = self.weights_of(counts[by])
        norm = np.sqrt(np.bincount(owner, w * w, len(starts) - 1))
        return flat[by], w / norm[owner]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, starts) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]], starts - starts[0]


def by_size(starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows of that size, their positions as a matrix)."""
    sizes = np.diff(starts)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, starts[rows][:, None] + np.arange(n)


def slices(rows: np.ndarray, width: int, most: int = 1_000_000) -> Iterator[slice]:
    """Parts of ``rows`` whose matrices of ``width`` columns hold at most ``most`` numbers (or one row)."""
    step = max(1, most // max(1, width))
    for lo in range(0, len(rows), step):
        yield slice(lo, lo + step)


def pair_columns(p: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of the first ``p`` positions."""
    i, j = np.triu_indices(p, 1)
    return i, j


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of an ordered pair of words."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C159E3779B9)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)


def fingerprints(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits per set: each word flips one bit. The Hamming distance of two fingerprints is at most the number
    of words found in one set only."""
    bits = np.uint64(1) << ((flat.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
    out = np.zeros(len(starts) - 1, np.uint64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.bitwise_xor.reduceat(bits, starts[:-1][full])
    return out.astype(np.int64)


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (id, ..., c), classes (c, n, w)): records with equal word sets form one class, named by its smallest id."""
    first = runtime.table(rows.groupBy("k").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("rows")))
    named = runtime.table(join_per_key(rows, first, ["k"], "rows", F.col("id")).drop("k").distinct())
    classes = runtime.table(named.filter("id = c").select("c", F.size("w").alias("n"), "w").distinct())
    return named.drop("w"), classes
