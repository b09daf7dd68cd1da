"""Near-duplicate records with small edits (problem 4), by multi-index hashing without loss.

The fingerprint of a record is the incidence vector of its words, held as 64-bit hashes in one global order,
rare words first. Similarity s or more means a Hamming distance of at most (1-s)/(1+s) * (n_a + n_b). The
segment that is hashed is the rare end of the vector: so many words that two records within the distance share
at least KEPT of them. The Hamming ball enumerated around it is all ways to delete the other words, each
leaving KEPT words as the key of a table; the shorter record of a pair is stored with the smaller ball, the
longer looks it up with the larger. The keys of pairs of words grow with the square of the record, so pairs whose
longer record has more than LONG words go by single words of a segment that is one word shorter: these keys grow
with the record, and words of long records are rare. Matches are screened by the distance of 64-bit folded
fingerprints, then verified by the complete distance. Segments cut by hash, and simhash, cannot do this at 0.6 with
few candidates: see the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import vectors
from corpusloom.llm.groups import hash_to_min
from corpusloom.operators.skew import join_per_key, join_spread

MIN_WORDS, SIMILARITY = 8, Fraction(3, 5)
KEPT = 2
#: Pairs whose longer record has more words go by single words.
LONG = 64


def least_overlap(n: int, s: Fraction, shorter: bool) -> int:
    """Words that a record of ``n`` shares at least with any similar record that is not shorter (or not longer)."""
    return math.ceil(2 * s / (1 + s) * n) if shorter else math.ceil(s * n)


def uses(n: int, s: Fraction, long: int = LONG) -> list[tuple[bool, int]]:
    """(stored, words in a key) of the entries of a record of ``n`` words: it is stored for longer records, which may
    be beyond ``long``, and looks up shorter ones."""
    out = [(False, KEPT if n <= long else 1)]
    if n <= long:
        out.append((True, KEPT))
    if n >= s * (long + 1):
        out.append((True, 1))
    return out


def _entries(batches: Iterator[pa.RecordBatch], order: vectors.Order, s: Fraction, long: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, starts = vectors.lists(b.column("w"))
        if not b.num_rows:
            continue
        prints = vectors.fingerprints(flat, starts)
        ids = b.column("c").to_numpy()
        ordered, _ = order.sort(flat, starts)
        for n, rows, at in vectors.by_size(starts):
            for stored, kept in uses(n, s, long):
                p = min(n, n - least_overlap(n, s, stored) + kept)
                i, j = vectors.pair_columns(p) if kept == KEPT else (np.arange(p),) * 2
                m = len(i)
                for part in vectors.slices(rows, m):
                    own, cells = rows[part], at[part]
                    keys = vectors.mixed(ordered[cells[:, i]], ordered[cells[:, j]])
                    size = len(own) * m
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(ids[own], m)), pa.array(np.full(size, n, np.int32)), pa.array(np.repeat(prints[own], m)), pa.array(np.full(size, stored))],
                        ["key", "c", "n", "f", "stored"],
                    )


def similar_classes(classes: DataFrame, s: Fraction = SIMILARITY, order: vectors.Order | None = None, long: int = LONG) -> DataFrame:
    """(a, b, common, either): pairs of classes (c, n, w) with similarity of at least ``s``, a before b."""
    order = order or vectors.Order(*vectors.frequent(classes))
    table = classes.mapInArrow(lambda x: _entries(x, order, s, long), "key bigint, c bigint, n int, f bigint, stored boolean")
    table = runtime.table(table)
    x = table.filter("stored").select("key", F.col("c").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"))
    y = table.filter("NOT stored").select("key", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"))
    # Whole numbers: distance <= na + nb - 2 * ceil(s / (1 + s) * (na + nb)).
    p, q = s.numerator, s.numerator + s.denominator
    need = F.expr(f"(({p} * (na + nb) + {q - 1}) div {q})")
    near = F.expr("bit_count(fa ^ fb)") <= F.col("na") + F.col("nb") - 2 * need
    order_ok = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = x.join(y, "key").filter(order_ok & (F.col("na") * s.denominator >= F.col("nb") * s.numerator) & near).select("a", "b").distinct()
    found = runtime.table(found)
    runtime.release(table)
    wa, wb = classes.select(F.col("c").alias("a"), F.col("w").alias("wa")), classes.select(F.col("c").alias("b"), F.col("w").alias("wb"))
    full = found.join(wa, "a").join(wb, "b").withColumn("common", F.size(F.array_intersect("wa", "wb"))).withColumn("either", F.size("wa") + F.size("wb") - F.col("common"))
    return full.filter(F.col("common") * s.denominator >= F.col("either") * s.numerator).select("a", "b", "common", "either")


def near_pairs(df: DataFrame, key: str, text: str, min_words: int = MIN_WORDS, s: Fraction = SIMILARITY) -> DataFrame:
    """(id_a, id_b): all pairs of different ids, smaller first, whose word sets are at least ``s`` similar.

    Null ids and texts and texts of fewer than ``min_words`` different words take no part; rows repeated under one
    id count once; equal word sets are compared once, as a class. An empty table gives no rows.
    """
    if min_words < 1 or least_overlap(min_words, s, False) < KEPT:
        raise ValueError(f"min_words must leave {KEPT} shared words at this similarity")
    named, classes = vectors.classes_of(vectors.members(df, key, text, min_words))
    pairs = runtime.table(similar_classes(classes, s).select("a", "b"))
    ids = named.select("id", "c")
    left, right = ids.select(F.col("id").alias("x"), F.col("c").alias("a")), ids.select(F.col("id").alias("y"), F.col("c").alias("b"))
    across = join_spread(join_spread(left, pairs, ["a"], F.col("x")), right, ["b"], F.col("x")).select("x", "y")
    within = join_spread(left.withColumnRenamed("a", "c"), right.withColumnRenamed("b", "c"), ["c"], F.col("x")).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_groups(df: DataFrame, key: str, text: str, min_words: int = MIN_WORDS, s: Fraction = SIMILARITY) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per record of enough words: its class of equal word sets, the
    group it is linked into directly or through others, and the number of similar other classes."""
    named, classes = vectors.classes_of(vectors.members(df, key, text, min_words))
    pairs = runtime.table(similar_classes(classes, s).select("a", "b"))
    groups = hash_to_min(pairs)
    links = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    ids = named.select("id", "c").distinct()
    per = ids.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(groups.withColumnRenamed("id", "c"), "c", "left").join(links, "c", "left")
    per = runtime.table(per.select("c", "n", F.coalesce("group_id", "c").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return join_per_key(ids, per, ["c"], "n", F.col("id")).select("id", F.col("c").alias("class_id"), "group_id", "n_links")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf}/train_clips.parquet"), "id", "cleaned_text")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf}/train_clips.parquet"), "id", "cleaned_text")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL: dict[str, str] = {}
