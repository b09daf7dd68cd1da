"""Evaluation texts leaking into training text (problem 7): q-gram lemma filtering.

Items and documents become streams of folded symbols, words parted by one space. Every shared q-gram of
characters is a hit on the diagonal document position - item position. In overlapping bands of diagonals the
hits are chained; a passage of L characters with at most k edits keeps at least L + 1 - q * (k + 1) of its
q-grams within one band, so bands with fewer hits are dropped and nothing else is. What remains is verified by
a banded local alignment: the passage must score as much as L characters with k edits would. The items are a
stated query set: they are sent to the executors in blocks of bounded size, the documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import forms, stream
from corpusloom.llm.arrow import with_columns
from corpusloom.llm.lookalikes import OTHER, repair, repair_text, shaped_words

RUN, EDITS, Q = 12, 1, 16
BAND = 8  # diagonals in a band; bands overlap by half
PENALTY = 4
#: Characters of items in one block (one pass over the documents), and symbols of documents handled at once.
BLOCK, CHUNK = 4_000_000, 1_000_000
BASE = 0x9E3779B97F4A7C15
END = 1  # a symbol that no text has
BITS = 22


def squeeze(sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of spaces to one, none at either end of a text; an END after each text."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    gap = sym == stream.SPACE
    before = np.ones(len(sym), bool)  # a text begins or a space stands before
    if len(sym):
        before[1:] = gap[:-1]
        before[starts[:-1][np.diff(starts) > 0]] = True
    keep = ~(gap & before)
    last = np.ones(len(sym), bool)
    last[:-1] = False
    kept, own = sym[keep], owner[keep]
    if len(kept):  # a space at the end of a text
        tail = np.ones(len(own), bool)
        tail[:-1] = own[1:] != own[:-1]
        drop = tail & (kept == stream.SPACE)
        kept, own = kept[~drop], own[~drop]
    sizes = np.bincount(own, minlength=n) + 1
    out_starts = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=out_starts[1:])
    out = np.full(int(out_starts[-1]), END, np.int32)
    body = np.ones(len(out), bool)
    body[out_starts[1:] - 1] = False
    out[body] = kept
    return out, out_starts


def qgrams(sym: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value of each q consecutive symbols (q a power of two), by doubling."""
    h, base, width = sym.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), BASE, 1
    while width < q:
        h = h[: len(h) - width] * np.uint64(base) + h[width:] if len(h) > width else h[:0]
        base, width = base * base % (1 << 64), width * 2
    return h


@dataclass
class Items:
    """Prepared items of one block."""

    ids: np.ndarray
    sym: np.ndarray
    starts: np.ndarray
    grams: np.ndarray  # sorted
    at: np.ndarray  # position in sym of each
    bits: np.ndarray
    length: np.ndarray  # characters of each item's shortest run of RUN words
    runs: list[set[str]]
    vocabulary: frozenset[str]
    run: int
    edits: int
    q: int


def prepare(ids: list[int], texts: list[str | None], run: int = RUN, edits: int = EDITS, q: int = Q) -> Items:
    forms_ = [forms.shape(t) or "" for t in texts]
    vocabulary = frozenset(w for t in forms_ for w in forms.words(t))
    sym, starts = squeeze(*stream.fold(forms_, words=True))
    length, runs = [], []
    for a, b in zip(starts[:-1], starts[1:] - 1, strict=True):
        w = "".join(map(chr, sym[a:b])).split(" ")
        own = {" ".join(w[i : i + run]) for i in range(len(w) - run + 1)}
        runs.append(own)
        length.append(min(map(len, own)) if own else 1 << 40)
    h = qgrams(sym, q)
    owner = np.searchsorted(starts, np.arange(len(h)), "right") - 1
    inside = np.arange(len(h)) + q < starts[owner + 1]
    inside &= np.array([bool(r) for r in runs], bool)[owner] if runs else False
    at = np.flatnonzero(inside)
    by = np.argsort(h[at], kind="stable")
    at = at[by]
    bits = np.zeros(1 << BITS, bool)
    bits[h[at] >> np.uint64(64 - BITS)] = True
    return Items(np.array(ids, np.int64), sym, starts, h[at], at, bits, np.array(length, np.int64), runs, vocabulary, run, edits, q)


def hits(sym: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(document position, position among the items' symbols) of all shared q-grams."""
    h = qgrams(sym, items.q)
    pos = np.flatnonzero(items.bits[h >> np.uint64(64 - BITS)])
    h = h[pos]
    lo = np.searchsorted(items.grams, h, "left")
    n = np.searchsorted(items.grams, h, "right") - lo
    pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
    skip = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(pos, n), items.at[np.repeat(lo, n) + skip]


@dataclass
class Regions:
    doc: np.ndarray
    item: np.ndarray
    diagonal: np.ndarray  # lowest of the band
    first: np.ndarray  # document positions
    last: np.ndarray


def regions(sym_starts: np.ndarray, pos: np.ndarray, ipos: np.ndarray, items: Items) -> Regions:
    """Chains of hits in one band that meet the bound of the q-gram lemma."""
    doc = np.searchsorted(sym_starts, pos, "right") - 1
    item = np.searchsorted(items.starts, ipos, "right") - 1
    d = (pos - sym_starts[doc]) - (ipos - items.starts[item])
    half = BAND // 2
    made = []
    for grid in (0, half):  # a passage strays over at most `edits` diagonals: it is whole in one of the bands
        band = (d + grid) // BAND
        by = np.lexsort((pos, band, item, doc))
        k = np.stack([doc[by], item[by], band[by]])
        if not k.shape[1]:
            continue
        p = pos[by]
        new = np.ones(len(p), bool)
        # Edits apart, hits of one passage are at most q + edits positions from the next.
        new[1:] = (k[:, 1:] != k[:, :-1]).any(0) | (p[1:] - p[:-1] > items.q * (items.edits + 1) + items.edits)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(p)) - 1
        distinct = np.add.reduceat((np.append(True, p[1:] != p[:-1]) | new).astype(np.int64), head)
        bound = np.maximum(1, items.length[k[1, head]] + 1 - items.q * (items.edits + 1))
        ok = distinct >= bound
        made.append((k[0, head][ok], k[1, head][ok], k[2, head][ok] * BAND - grid, p[head][ok], p[tail][ok]))
    cols = [np.concatenate(c) if made else np.zeros(0, np.int64) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 5
    return Regions(*cols)


def align(sym: np.ndarray, sym_starts: np.ndarray, r: Regions, items: Items, at_once: int = 2048) -> np.ndarray:
    """Best local score of each region within its band: +1 for a match, -PENALTY for an edit."""
    best = np.zeros(len(r.doc), np.int32)
    width = BAND + 2 * items.edits
    for lo in range(0, len(r.doc), at_once):
        s = slice(lo, min(lo + at_once, len(r.doc)))
        doc, item, d0 = r.doc[s], r.item[s], r.diagonal[s] - items.edits
        rim = items.length[item] + items.q
        a = np.maximum(sym_starts[doc], r.first[s] - rim)
        b = np.minimum(sym_starts[doc + 1] - 1, r.last[s] + items.q + rim)
        i0, i1 = items.starts[item], items.starts[item + 1] - 1
        h = np.zeros((len(doc), width + 2), np.int32)  # a column of zeros on either side
        top = np.zeros(len(doc), np.int32)
        for step in range(int((b - a).max()) if len(doc) else 0):
            p = a + step
            live = p < b
            c = sym[np.where(live, p, 0)]
            j = i0[:, None] + (p - sym_starts[doc])[:, None] - (d0[:, None] + np.arange(width))
            inside = (j >= i0[:, None]) & (j < i1[:, None]) & live[:, None]
            same = items.sym[np.where(inside, j, 0)] == c[:, None]
            new = np.maximum(h[:, 1:-1] + np.where(same, 1, -PENALTY), h[:, :-2] - PENALTY)
            new = np.where(inside, np.maximum(new, 0), 0)
            for k in range(width - 2, -1, -1):  # an item character without a partner
                np.maximum(new[:, k], new[:, k + 1] - PENALTY, out=new[:, k])
            h[:, 1:-1] = new
            np.maximum(top, new.max(1), out=top)
        best[s] = top
    return best


def matches(texts: list[str | None], items: Items, exact: bool = True) -> list[tuple[int, int]]:
    """(row, index of the item) of all leaks in a batch of texts."""
    out: set[tuple[int, int]] = set()
    if not len(items.grams):
        return []
    special = lambda t: repair_text(forms.shape(t), items.vocabulary)

    def work(part: list[str], rows: list[int]) -> None:
        sym, starts = squeeze(*stream.fold(part, words=True, exact=special))
        pos, ipos = hits(sym, items)
        if not len(pos):
            return
        r = regions(starts, pos, ipos, items)
        need = items.length[r.item] - items.edits * (1 + PENALTY)
        good = align(sym, starts, r, items) >= need
        own: dict[int, set[str]] = {}
        for k in np.flatnonzero(good):
            doc, item = int(r.doc[k]), int(r.item[k])
            if exact:
                if doc not in own:
                    w = "".join(map(chr, sym[starts[doc] : starts[doc + 1] - 1])).split(" ")
                    own[doc] = {" ".join(w[i : i + items.run]) for i in range(len(w) - items.run + 1)}
                if own[doc].isdisjoint(items.runs[item]):
                    continue
            out.add((rows[doc], item))

    part, rows, size = [], [], 0
    for row, t in enumerate(texts):
        if not t:
            continue
        if len(t) > CHUNK:  # a very long text goes alone; its arrays are a bounded multiple of its length
            work([t], [row])
            continue
        part.append(t)
        rows.append(row)
        size += len(t)
        if size >= CHUNK:
            work(part, rows)
            part, rows, size = [], [], 0
    if part:
        work(part, rows)
    return sorted(out)


def repaired_items(items: DataFrame, key: str, text: str, documents: DataFrame, doc_text: str) -> DataFrame:
    """(i, t): the items, their look-alike letters repaired by the words of documents and items. The documents are read
    for their words only where an item holds letters that may be look-alikes."""
    rows = items.select(F.col(key).alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    odd = rows.filter(F.col("t").rlike(OTHER))
    if odd.isEmpty():
        return rows
    shaped = with_columns(odd, {"__shaped": ("string", lambda v: [forms.shape(x) for x in v])}, "t", drop=("t",)).withColumnRenamed("__shaped", "t")
    texts = documents.select(F.col(doc_text).alias("t")).unionByName(rows.select("t"))
    return rows.filter(~F.col("t").rlike(OTHER)).unionByName(repair(runtime.table(shaped), "t", shaped_words(texts, "t")))


_READY: dict[str, Items] = {}


def _once(name: str, make: Callable[[], Items]) -> Items:
    """What ``make`` gives, made once in a worker process for all tasks of the same name; the last one is kept."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = make()
    return _READY[name]


def item_blocks(items: DataFrame, key: str, text: str, block: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """The query set in blocks of at most ``block`` characters (or one item)."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(key).alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        if ids and size + len(row.t) > block:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    if ids:
        yield ids, texts


def leaks(documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, run: int = RUN, edits: int = EDITS, exact: bool = True, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): documents and items that share a passage of ``run`` words with at most ``edits`` edits, or,
    with ``exact``, ``run`` equal consecutive words.

    Null ids and texts take no part; items of fewer than ``run`` words match nothing. Repeated documents or items
    give one row for each pair of ids. Whole texts are searched, however long.
    """
    if not 0 <= edits <= BAND // 2:
        raise ValueError(f"edits must be between 0 and {BAND // 2}")
    spark = documents.sparkSession
    items = repaired_items(items, item_key, item_text, documents, doc_text)
    docs = documents.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for ids, texts in item_blocks(items, "i", "t", block):
        sent = spark.sparkContext.broadcast((ids, texts))  # at most `block` characters
        name = uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            ready = _once(name, lambda: prepare(*sent.value, run, edits))
            for b in batches:
                pairs = matches(b.column("text").to_pylist(), ready, exact)
                rows, at = [p[0] for p in pairs], [p[1] for p in pairs]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ready.ids[np.array(at, np.int64)])], ["doc_id", "item_id"])

        part = docs.mapInArrow(search, "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return found.distinct()


def _found(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return leaks(read("documents"), read("heldout_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)


def p7_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items that share a passage of 12 words with at most one edit of a character."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return leaks(read("documents"), read("heldout_items"), "doc_id", "text", "item_id", "text", exact=False)


def p7_leak_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per held-out split and item: the documents it leaked into."""
    items = spark.read.parquet(f"{sf}/heldout_items.parquet").select("item_id", "split")
    return _found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).join(items, "item_id").select("split", "item_id", "n_docs", "first_doc")


QUERIES = {"p7_found": p7_found, "p7_edited": p7_edited, "p7_leak_report": p7_leak_report}
SQL: dict[str, str] = {}
