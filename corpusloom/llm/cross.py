"""Same or near-same records across splits (problem 3): a weighted cosine join with inverted lists.

Both sides become term-weight vectors of unit length in one global term order, rare first; weights grow with the
inverse document frequency. For every list the largest weight m_i of its term on the other side is known (for rare
terms the largest of all rare ones). Vectors of at most LONG terms are listed under pairs of their terms: (i, j) is
kept for which

    w_i * m_i + w_j * m_j + |w after j| >= threshold,

as no similar vector has i and j as its first two shared terms otherwise; and under single terms with
w_i * m_i >= threshold, by which alone a similar vector can share just one term. Pairs with a longer vector go by
lists of single terms throughout, (i) being kept for which w_i * m_i + |w after i| >= threshold: their number grows
with the vector, that of pairs with its square. A match of two entries stays when the products of the terms plus the
product of both residual norms reach the threshold. What remains gets its exact dot product. All this loses nothing.

Similarity s of word sets implies a cosine of at least 1 / (1 + r * (1-s) / (2s)), r being the ratio of the largest to
the least squared weight: of n_a + n_b - 2c differing words no more than (1-s)/s * c, each at most r times as heavy
as a shared one, and the geometric mean of both norms is at most their arithmetic mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import vectors
from corpusloom.operators.skew import join_per_key, join_spread

MIN_WORDS, SIMILARITY = 8, Fraction(3, 5)
SLACK = 1e-9
#: Ratio of the largest to the least squared weight.
RATIO = 2.0
#: Vectors of more terms are listed under single terms only.
LONG = 64


def bound(s: Fraction, ratio: float) -> float:
    """The least cosine of word sets of similarity ``s`` under weights of this ratio."""
    return 1 / (1 + ratio * float((1 - s) / (2 * s)))


def _vectors(batches: Iterator[pa.RecordBatch], order: vectors.Order) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, starts = vectors.lists(b.column("w"))
        terms, weights = order.sort(flat, starts)
        offsets = pa.array(starts.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column("c"), pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(weights)), pa.array(vectors.fingerprints(flat, starts))], ["c", "t", "x", "f"]
        )


@dataclass
class Other:
    """What a side must know of the other one: the largest weight of each frequent term and, last, of all rare ones, and
    whether it has vectors of more than LONG terms."""

    order: vectors.Order
    largest: np.ndarray
    any_long: bool


def _other(side: DataFrame, order: vectors.Order, long: int) -> Other:
    frequent = F.transform("x", lambda v, i: F.struct(F.get("t", i).alias("t"), v.alias("v")))
    spark = side.sparkSession
    known = F.broadcast(spark.createDataFrame([(int(h),) for h in order.hashes], "t bigint").withColumn("known", F.lit(True)))  # at most FREQUENT rows
    per = side.select(F.explode(frequent).alias("e")).select("e.*").groupBy("t").agg(F.max("v").alias("v")).join(known, "t", "left")
    per = per.groupBy(F.when(F.col("known"), F.col("t")).alias("t")).agg(F.max("v").alias("v")).toPandas()
    largest = np.zeros(len(order.hashes) + 1)
    rare = per.t.isna()
    largest[-1] = per.v[rare].max() if rare.any() else 0.0
    largest[order.place(per.t[~rare].to_numpy(np.int64))] = per.v[~rare]
    return Other(order, largest, not side.filter(F.size("t") > long).isEmpty())


def _masks(w: np.ndarray, m: np.ndarray, threshold: float, pairs: bool, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first term, second term, rows x entries that are kept) for a matrix of weights and one of the other side's
    largest; the second term is the first where entries are single terms."""
    rest = np.sqrt(np.maximum(0, np.cumsum((w * w)[:, ::-1], 1)[:, ::-1] - w * w))
    own = w * m
    if not pairs:
        i = np.arange(w.shape[1])
        return i, i, (own + (rest if whole else 0)) >= threshold - SLACK
    before = np.maximum.accumulate(own, 1)[:, :-1]
    reach = (before + own[:, 1:] + rest[:, 1:] >= threshold - SLACK).any(0)
    p = int(np.flatnonzero(reach).max()) + 2 if reach.any() else 0
    i, j = vectors.pair_columns(p)
    return i, j, own[:, i] + own[:, j] + rest[:, j] >= threshold - SLACK


def _postings(batches: Iterator[pa.RecordBatch], other: Other, threshold: float, long: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        t, starts = vectors.lists(b.column("t"))
        x, _ = vectors.lists(b.column("x"))
        most = other.largest[other.order.place(t)]
        ids, prints = b.column("c").to_numpy(), b.column("f").to_numpy()
        for n, rows, at in vectors.by_size(starts):
            for pairs in (True, False) if n <= long else (False,):
                for part in vectors.slices(rows, n * n // 2 if pairs else n):
                    own, cells = rows[part], at[part]
                    w = x[cells]
                    i, j, keep = _masks(w, most[cells], threshold, pairs, n > long or other.any_long)
                    r, e = np.nonzero(keep)
                    if not len(r):
                        continue
                    first, second = cells[r, i[e]], cells[r, j[e]]
                    rest = np.sqrt(np.maximum(0, np.cumsum((w * w)[:, ::-1], 1)[:, ::-1] - w * w))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(vectors.mixed(t[first], t[second])), pa.array(ids[own[r]]), pa.array(np.full(len(r), n, np.int32)), pa.array(prints[own[r]]),
                            pa.array(x[first].astype(np.float32)), pa.array((x[second] if pairs else np.zeros(len(r))).astype(np.float32)), pa.array(rest[r, j[e]].astype(np.float32)),
                        ],
                        ["key", "c", "n", "f", "wi", "wj", "r"],
                    )


LIST = "key bigint, c bigint, n int, f bigint, wi float, wj float, r float"


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, ratio: float = RATIO, unit_distance: Fraction | None = None, long: int = LONG) -> DataFrame:
    """(a, b, na, nb, common, cosine): pairs of ``left`` and ``right`` classes (c, n, w) with a cosine of at least
    ``threshold``, with their numbers of terms and of common ones.

    Empty sides give no rows. ``unit_distance`` (similarity of the word sets) drops matches whose fingerprints show
    that the sets are less similar.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    both = left.select("c", "n", "w").unionByName(right.select("c", "n", "w"))
    order = vectors.Order(*vectors.frequent(both), ratio)
    made = "c bigint, t array<bigint>, x array<double>, f bigint"
    lv, rv = (runtime.table(d.mapInArrow(lambda b: _vectors(b, order), made)) for d in (left, right))
    of_left, of_right = _other(lv, order, long), _other(rv, order, long)
    a = lv.mapInArrow(lambda b: _postings(b, of_right, threshold, long), LIST).toDF("key", "a", "na", "fa", "ai", "aj", "ar")
    b = rv.mapInArrow(lambda x: _postings(x, of_left, threshold, long), LIST).toDF("key", "b", "nb", "fb", "bi", "bj", "br")
    hit = F.expr("ai * bi + aj * bj + ar * br") >= threshold - 1e-5
    # Two short vectors meet under a single term only where that alone is enough: else they meet under two.
    hit &= F.expr(f"aj > 0 OR na > {long} OR nb > {long} OR ai * bi >= {threshold - 1e-5}")
    if unit_distance is not None:
        s = unit_distance
        p, q = s.numerator, s.numerator + s.denominator
        hit &= F.expr(f"bit_count(fa ^ fb) <= na + nb - 2 * (({p} * (na + nb) + {q - 1}) div {q})")
    found = runtime.table(a.join(b, "key").filter(hit).select("a", "b").distinct())
    va = lv.select(F.col("c").alias("a"), F.size("t").alias("na"), F.map_from_arrays("t", "x").alias("va"))
    vb = rv.select(F.col("c").alias("b"), F.size("t").alias("nb"), F.arrays_zip("t", "x").alias("vb"))
    shared = F.filter(F.transform("vb", lambda y: y["x"] * F.try_element_at("va", y["t"])), lambda z: z.isNotNull())
    met = found.join(va, "a").join(vb, "b").withColumn("shared", shared)
    dot = F.aggregate("shared", F.lit(0.0), lambda acc, z: acc + z)
    return met.select("a", "b", "na", "nb", F.size("shared").alias("common"), dot.alias("cosine")).filter(F.col("cosine") >= threshold - SLACK)


def similar_classes(held: DataFrame, train: DataFrame, s: Fraction, ratio: float = RATIO) -> DataFrame:
    """(a, b): classes of ``held`` and ``train`` whose word sets are at least ``s`` similar."""
    near = cosine_join(held, train, bound(s, ratio), ratio, unit_distance=s)
    return runtime.table(near.filter(F.col("common") * s.denominator >= (F.col("na") + F.col("nb") - F.col("common")) * s.numerator).select("a", "b"))


def overlaps(held: DataFrame, train: DataFrame, key: str, text: str, labels: tuple[str, ...], min_words: int = MIN_WORDS, s: Fraction = SIMILARITY) -> DataFrame:
    """(*labels, held_id, train_id): every pair of a held-out and a training record with the same id, or whose word
    sets are at least ``s`` similar.

    Null ids take no part; null texts and texts of fewer than ``min_words`` different words only by id. Rows
    repeated whole count once. Equal word sets are compared once. Empty tables give no rows.
    """
    hm, hc = vectors.classes_of(vectors.members(held, key, text, min_words, labels))
    tm, tc = vectors.classes_of(vectors.members(train, key, text, min_words))
    exact = similar_classes(hc, tc, s)
    left = join_spread(hm.withColumnRenamed("id", "held_id").withColumnRenamed("c", "a"), exact, ["a"], F.col("held_id"))
    pairs = join_spread(left, tm.withColumnRenamed("id", "train_id").withColumnRenamed("c", "b"), ["b"], F.col("held_id"))
    same = _same_ids(held, train, key, labels)
    names = [*labels, "held_id", "train_id"]
    return pairs.select(*names).unionByName(same.select(*names)).distinct()


def _same_ids(held: DataFrame, train: DataFrame, key: str, labels: tuple[str, ...]) -> DataFrame:
    mine = held.select(F.col(key).alias("held_id"), *labels)
    return mine.join(train.select(F.col(key).alias("train_id")).distinct(), F.col("held_id") == F.col("train_id"))


def overlap_classes(held: DataFrame, train: DataFrame, key: str, text: str, labels: tuple[str, ...], min_words: int = MIN_WORDS, s: Fraction = SIMILARITY) -> DataFrame:
    """(*labels, held_id, class_id, n_links): one row for each held-out record that overlaps: the smallest id of the
    records with its words, and the number of training records it overlaps with, by similarity or by the same id.
    Counted by the sizes of classes; no pair of records is made but those of one id."""
    hm, hc = vectors.classes_of(vectors.members(held, key, text, min_words, labels))
    tm, tc = vectors.classes_of(vectors.members(train, key, text, min_words))
    exact = similar_classes(hc, tc, s)
    tm, hm = runtime.table(tm.select("id", "c").distinct()), runtime.table(hm)
    sizes = tm.groupBy("c").agg(F.countDistinct("id").alias("size"))
    per = exact.join(sizes, exact.b == sizes.c).groupBy("a").agg(F.sum("size").alias("links"))
    per = hm.groupBy(F.col("c").alias("a")).agg(F.count(F.lit(1)).alias("n")).join(per, "a", "left")
    near = join_per_key(hm.withColumnRenamed("c", "a"), runtime.table(per), ["a"], "n", F.col("id"))
    near = near.groupBy(F.col("id").alias("held_id"), *labels).agg(F.min("a").alias("class_id"), F.sum("links").alias("links"))
    # A training record of the same id is one more link, unless its words made it one already.
    same = _same_ids(held, train, key, labels).select("held_id", *labels).distinct()
    mine = hm.select(F.col("id").alias("held_id"), *labels, F.col("c").alias("a"))
    theirs = tm.select(F.col("id").alias("held_id"), F.col("c").alias("b"))
    already = same.join(mine, ["held_id", *labels]).join(theirs, "held_id").join(exact, ["a", "b"]).select("held_id", *labels).distinct().withColumn("already", F.lit(1))
    both = near.join(same.withColumn("same", F.lit(1)), ["held_id", *labels], "full").join(already, ["held_id", *labels], "left")
    links = F.coalesce("links", F.lit(0)) + F.coalesce("same", F.lit(0)) - F.coalesce("already", F.lit(0))
    return both.select(*labels, "held_id", F.coalesce("class_id", "held_id").alias("class_id"), links.alias("n_links")).filter("n_links > 0")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return overlaps(read("val_clips"), read("train_clips"), "id", "cleaned_text", ("split", "source"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf)
    return found.select("split", "source", F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b")).distinct()


def p3_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source: held-out records that overlap, training records they meet, pairs, pairs of one id."""
    return _found(spark, sf).groupBy("split", "source").agg(
        F.countDistinct("held_id").alias("n_held"), F.countDistinct("train_id").alias("n_train"), F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("held_id") == F.col("train_id")).alias("n_same_id")
    )


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return overlap_classes(read("val_clips"), read("train_clips"), "id", "cleaned_text", ("split", "source"))


QUERIES = {"p3_found": p3_found, "p3_overlap_report": p3_overlap_report, "p3_classes": p3_classes}
SQL: dict[str, str] = {}
