"""Duplicates hidden by formatting (problem 6).

Each text is streamed through the skip-and-fold table into rolling polynomial hashes; rows of equal hash are
verified against the first row of their group by a two-pointer comparison that skips the same characters. Rows
that fail it (a hash collision) are grouped again by a digest of their symbols, so the result is exact.
Manifest records are parsed; the hash of a record is the sum over its fields of a hash of name and value, so
the order of the fields does not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import forms, stream
from corpusloom.llm.arrow import with_columns
from corpusloom.llm.lookalikes import repair, shaped_words
from corpusloom.operators.skew import join_per_key

MIN_LETTERS = 15
MASK = (1 << 62) - 1
#: A text that the table alone cannot fold: combining marks or letters that may be look-alikes.
IRREGULAR = r"[\p{IsGreek}\p{IsCyrillic}\x{0300}-\x{036F}\x{0653}-\x{0655}]"


def _text_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sym, starts = stream.fold(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("id"), b.column("s"), pa.array(stream.hashes(sym, starts)), pa.array((starts[1:] - starts[:-1]).astype(np.int32))], NAMES)


def _number(v: float | int) -> str:
    return repr(int(v)) if isinstance(v, int) or float(v).is_integer() else repr(v)


def leaves(value, name: str = "") -> Iterator[tuple[str, str, str]]:
    """(folded name path, kind, value) of every leaf of a parsed record; names are folded to lower case."""
    if isinstance(value, list):  # parsed objects come as lists of pairs, arrays as tuples
        yield name, "o", str(len(value))
        for k, v in value:
            yield from leaves(v, f"{name}\x1f{k.strip().lower()}")
    elif isinstance(value, tuple):
        yield name, "a", str(len(value))
        for k, v in enumerate(value):
            yield from leaves(v, f"{name}\x1f#{k}")
    elif value is None:
        yield name, "n", ""
    elif isinstance(value, bool):
        yield name, "b", str(value)
    elif isinstance(value, str):
        yield name, "s", value
    else:
        yield name, "d", _number(value)


class _Pairs(list):
    """The fields of an object in their order."""


def parse(payload: str | None):
    """The record as nested lists of fields, or None when it is null, cut off or no object."""
    if payload is None:
        return None

    def plain(v):
        if isinstance(v, _Pairs):
            return [(k, plain(x)) for k, x in v]
        return tuple(map(plain, v)) if isinstance(v, list) else v

    try:
        v = json.loads(payload, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return None
    return plain(v) if isinstance(v, _Pairs) else None


def record_key(payload: str | None) -> list[tuple[str, str, str]] | None:
    """The record's leaves in a fixed order with folded string values: equal for equal records."""
    v = parse(payload)
    if v is None:
        return None
    return sorted((n, k, forms.letters(forms.shape(x)) if k == "s" else x) for n, k, x in leaves(v))


def _record_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}  # hashes of field names: a few per schema

    def named(s: str) -> int:
        if s not in memo:
            if len(memo) > 10_000:
                memo.clear()
            memo[s] = int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
        return memo[s]

    for b in batches:
        texts, owner, salt, plus, ok = [], [], [], [], []
        sizes = np.zeros(b.num_rows, np.int32)
        for row, payload in enumerate(b.column("text").to_pylist()):
            v = parse(payload)
            ok.append(v is not None)
            for n, k, x in leaves(v) if v is not None else ():
                sizes[row] += 1
                owner.append(row)
                salt.append(named(f"{n}\x1e{k}"))
                texts.append(x if k == "s" else "")
                plus.append(0 if k == "s" else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") & MASK)
        h = np.zeros(b.num_rows, np.uint64)
        if texts:
            sym, starts = stream.fold(texts)
            value = stream.hashes(sym, starts).astype(np.uint64) + np.array(plus, np.uint64) + np.uint64(1)
            value *= np.array(salt, np.uint64)
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
            np.add.at(h, np.array(owner), value)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column("tab"), b.column("id"), b.column("s"), pa.array(h.astype(np.int64)), pa.array(sizes)], NAMES).filter(keep)


NAMES = ["tab", "id", "s", "h", "n"]
HASHED = "tab string, id bigint, s binary, h bigint, n int"


def text_rows(df: DataFrame, tab: str, key: str, text: str) -> DataFrame:
    """(tab, id, text) of the rows that have both."""
    return df.select(F.lit(tab).alias("tab"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``s``, a digest of the text: with tab and id it names the row that a hash belongs to."""
    return rows.withColumn("s", F.unhex(F.md5("text")))


def regular(rows: DataFrame) -> DataFrame:
    """``rows`` with the few irregular texts brought to the consistent form, so that the table can fold all."""
    odd = F.col("text").rlike(IRREGULAR)
    shaped = with_columns(rows.filter(odd), {"shaped": ("string", lambda v: [forms.shape(x) for x in v])}, "text", drop=("text",)).withColumnRenamed("shaped", "text")
    mixed = repair(runtime.table(shaped), "text", shaped_words(rows, "text"))
    return rows.filter(~odd).unionByName(mixed)


def text_hashes(rows: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """Hash and number of letters and digits of each of the regular texts that has at least ``min_letters`` of them; no text."""
    return stored(rows).mapInArrow(_text_hashes, HASHED).filter(F.col("n") >= min_letters)


def text_digests(rows: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, k): 128-bit digest of the letters and digits of each text of at least ``min_letters`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sym, starts = stream.fold(b.column("text").to_pylist())
            long = np.flatnonzero(starts[1:] - starts[:-1] >= min_letters)
            made = [hashlib.blake2b(sym[starts[i] : starts[i + 1]].tobytes(), digest_size=16).digest() for i in long]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(long)), pa.array(made, pa.binary())], ["id", "k"])

    return regular(rows).mapInArrow(run, "id bigint, k binary")


def record_hashes(rows: DataFrame) -> DataFrame:
    """Hash and number of fields of each record that can be parsed; no text."""
    return stored(rows).mapInArrow(_record_hashes, HASHED)


def _verified(batches: Iterator[pa.RecordBatch], records: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = b.column("text").to_pylist(), b.column("keep_text").to_pylist()
        kind = np.array([t in records for t in b.column("tab").to_pylist()], bool)
        same = np.zeros(b.num_rows, bool)
        for i in np.flatnonzero(kind):
            same[i] = record_key(left[i]) == record_key(right[i])
        plain = np.flatnonzero(~kind)
        same[plain] = stream.equal_streams([left[i] for i in plain], [right[i] for i in plain])
        digest = [None] * b.num_rows
        for i in np.flatnonzero(~same):  # a collision: told apart by all symbols
            x = repr(record_key(left[i])) if kind[i] else forms.letters(forms.shape(left[i]))
            digest[i] = hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        cols = [b.column(c) for c in ("tab", "keep_id", "copy_id", "h", "n")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(digest, pa.string())], ["tab", "keep_id", "copy_id", "h", "n", "digest"])


def copies(hashed: DataFrame, rows: DataFrame, records: tuple[str, ...] = ()) -> DataFrame:
    """(tab, keep_id, copy_id): every record that is a copy of one with a smaller id. ``hashed`` (tab, id, s, h, n) is
    written once; ``rows`` (tab, id, text) give the texts, of repeated hashes only; the tables ``records`` hold records.

    Rows repeated under one id count once (the same id never is its own copy). Groups may hold any share of the
    rows: the smallest id of each group is an aggregate with map-side combine, and it and the keeper's text reach
    the copies by joins that spread hot groups.
    """
    group = ["tab", "h", "n"]
    hashed = runtime.table(hashed)
    firsts = hashed.groupBy(*group).agg(F.min("id").alias("keep_id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("held")).filter("last > keep_id").drop("last")
    firsts = runtime.table(firsts)
    named = runtime.table(join_per_key(hashed, firsts, group, "held", F.col("id")).select(*group, "id", "s", "keep_id").distinct())
    runtime.release(hashed)
    members = runtime.table(stored(rows).join(named, ["tab", "id", "s"]).select(*group, "id", "text", "keep_id"))
    keepers = members.filter("id = keep_id").groupBy(*group).agg(F.first("text").alias("keep_text"))
    keepers = runtime.table(keepers.join(firsts.select(*group, "held"), group))
    pairs = join_per_key(members.filter("id > keep_id"), keepers, group, "held", F.col("id")).select("tab", "keep_id", F.col("id").alias("copy_id"), "h", "n", "text", "keep_text")
    checked = runtime.table(pairs.mapInArrow(lambda b: _verified(b, records), "tab string, keep_id bigint, copy_id bigint, h bigint, n int, digest string"))
    runtime.release(firsts, named, members, keepers)
    good = checked.filter("digest IS NULL").select("tab", "keep_id", "copy_id")
    again = checked.filter("digest IS NOT NULL")
    regrouped = again.groupBy(*group, "digest").agg(F.min("copy_id").alias("keep_id"))
    rest = again.drop("keep_id").join(regrouped, [*group, "digest"]).filter("copy_id > keep_id").select("tab", "keep_id", "copy_id")
    return good.unionByName(rest).distinct()


def text_copies(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Copies among the texts ``rows`` and among the records ``lines``, both (tab, id, text)."""
    rows = regular(rows)
    hashed = text_hashes(rows)
    if lines is None:
        return copies(hashed, rows)
    tabs = tuple(r.tab for r in lines.select("tab").distinct().collect())  # names of tables
    return copies(hashed.unionByName(record_hashes(lines)), rows.unionByName(lines), tabs)


def copy_counts(found: DataFrame) -> DataFrame:
    """(tab, keep_id, n_copies): one record each with the number of its copies under other ids."""
    return found.groupBy("tab", "keep_id").agg(F.count(F.lit(1)).alias("n_copies"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    texts = text_rows(read("raw_clips"), "raw_clips", "id", "text_raw").unionByName(text_rows(read("train_clips"), "train_clips", "id", "cleaned_text"))
    lines = text_rows(read("manifest_lines"), "manifest_lines", "line_id", "payload")
    return text_copies(texts, lines)


def p6_copy_counts(spark: SparkSession, sf: str) -> DataFrame:
    return copy_counts(p6_found(spark, sf))


QUERIES = {"p6_found": p6_found, "p6_copy_counts": p6_copy_counts}
SQL: dict[str, str] = {}
