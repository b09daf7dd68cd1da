"""Subject areas of documents (problem 9).

Documents become term-weight vectors (logarithmic counts times inverse document frequency, terms hashed into a
fixed number of buckets so that no vocabulary is ever gathered) and are embedded by a truncated singular value
decomposition, found by subspace iteration: each pass sends the current basis to the executors, and every
partition returns its share of X^T X Q for the terms it holds. Seed centroids come from the labelled documents,
one per subject and script, and are refined by reassigning all documents by cosine similarity. Sentences are embedded
in the same space. A sentence deals with a subject when the cosine of its embedding to the subject's centroid reaches
one threshold; a document is assigned the subject when its own cosine reaches another and at least a quarter of its
sentences, and two of them where it has two, deal with it. Both thresholds are those of a grid under which the
assignments agree best with the labels (F1).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import forms, stream
from corpusloom.llm.arrow import with_columns
from corpusloom.llm.lookalikes import OTHER, repair, shaped_words

BUCKETS = 1 << 17
RANK, PASSES, REFINEMENTS = 48, 4, 2
MIN_DOCS, MAX_SHARE = 5, 0.3
#: At most so many label rows are used, those of smallest hash of the document id.
MAX_LABELS = 100_000
#: The mean of all documents counts like so many in the mean of those labelled with no subject.
PRIOR = 20
#: A sentence of fewer than MIN_WORDS words (an interjection, a speaker's name) is none.
SHARE, MIN_WORDS = 0.25, 3
CLOSE = 0.6
#: Thresholds that are tried: of sentences, of documents.
SENTENCE_GRID = tuple(round(0.1 + 0.02 * k, 2) for k in range(21))
DOCUMENT_GRID = tuple(round(0.1 + 0.05 * k, 2) for k in range(9))
SENTENCE, DOC = 10, 1
CHUNK = 1_000_000
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDE = re.compile("[！-～]")
#: Numbers in the dense block that a few documents are multiplied as.
BLOCK = 4_000_000
# Inflection endings of Persian nouns and adjectives; the letters a stem needs are two before plural
# endings and three before the others.
ENDINGS = re.compile("(?<=..)(?:هایشان|هایمان|هایتان|هایی|هایش|هایم|هایت|های|ها)$|(?<=...)(?:شان|مان|تان|ترین|تر)$")


def _lut() -> np.ndarray:
    lut = stream.table(True).copy()
    for c in ".!?؟…\n\r。！？  \x85۔":
        lut[ord(c)] = SENTENCE
    lut[DOC] = DOC
    return lut


def bucket(word: str) -> int:
    """The term of a folded word: its endings are cut one after the other."""
    while m := ENDINGS.search(word):
        word = word[: m.start()]
    return zlib.crc32(word.encode()) * 2654435761 % (1 << 32) >> 15


def tokens(texts: list[str], lut: np.ndarray, memo: dict[str, int]) -> tuple[list[int], list[int], list[int], list[int], np.ndarray]:
    """(terms of all sentences, sizes of the sentences; terms and sentences of each text, and whether most of its letters are Latin)."""
    texts = [t.replace("\x01", " ") for t in texts]
    raw, starts = stream.codes(texts)
    special = np.flatnonzero(lut[raw] == stream.SPECIAL)
    for r in np.unique(np.searchsorted(starts, special, "right") - 1):
        texts[r] = forms.shape(texts[r])
    raw, _ = stream.codes(["\x01".join(texts)])
    sym = lut[raw]
    left = sym == stream.SPECIAL  # letters that stay what they are; combining marks alone are no letters
    sym[left] = [ord(chr(c).lower()[0]) if chr(c).isalnum() else stream.SPACE for c in raw[left]]
    text = sym[sym != 0].astype("<u4").tobytes().decode("utf-32-le")
    term = memo.__getitem__
    ends = np.flatnonzero(sym == DOC)
    bounds = np.concatenate([[0], ends, [len(sym)]])
    count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[bounds])
    latin = 2 * count((sym >= 97) & (sym <= 122)) > count(sym > SENTENCE) - count(sym == stream.SPACE)
    flat: list[int] = []
    sizes: list[int] = []
    n_terms, n_sentences = [], []
    for doc in text.split("\x01"):
        t, n = len(flat), len(sizes)
        for s in doc.split("\n"):
            words = s.split()
            if len(words) >= MIN_WORDS:
                flat += map(term, words)
                sizes.append(len(words))
        n_terms.append(len(flat) - t)
        n_sentences.append(len(sizes) - n)
    return flat, sizes, n_terms, n_sentences, latin


def _offsets(sizes) -> pa.Array:
    out = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=out[1:])
    return pa.array(out)


def _list(rows: list[np.ndarray], kind) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(_offsets([len(r) for r in rows]), pa.array(flat.astype(kind)))


def mostly_latin(text: str) -> bool:
    """Whether most of a text's visible characters are plain Latin letters."""
    if WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    plain = text.encode("ascii", "ignore")
    return 2 * (len(plain) - len(plain.translate(None, LETTERS))) > len(text) - text.count(" ")


class Memo(dict):
    """Terms of words seen so far; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = bucket(word)
        return b


def repaired(documents: DataFrame, text: str = "text", stored: str | None = None) -> DataFrame:
    """``documents`` with the few texts that hold Greek or Cyrillic letters brought to problem 2's form: shaped, and
    their look-alikes repaired by the words of all texts. All other texts and columns pass. A column ``stored`` is
    added on demand, with what these few texts were and null for all others."""
    own = lambda df, x: df.withColumn(stored, x) if stored else df
    odd = F.coalesce(F.col(text).rlike(OTHER), F.lit(False))
    shaped = with_columns(own(documents.filter(odd), F.col(text)), {"__shaped": ("string", lambda v: [forms.shape(x) for x in v])}, text, drop=(text,)).withColumnRenamed("__shaped", text)
    mended = runtime.table(repair(runtime.table(shaped), text, shaped_words(documents, text)))
    return own(documents.filter(~odd), F.lit(None).cast("string")).unionByName(mended)


TERMS = "doc_id bigint, latin boolean, terms array<int>, sizes array<int>, u array<int>, n array<int>"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lut, memo = _lut(), Memo()
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                size += len(texts[hi])
                hi += 1
            part = texts[lo:hi]
            flat, sizes, n_terms, n_sentences, latin = tokens(part, lut, memo)
            terms = np.array(flat, np.int32)
            # Terms and counts of all documents of the chunk at once.
            kinds, counts = np.unique(np.repeat(np.arange(len(part)), n_terms) * BUCKETS + terms, return_counts=True)
            n_kinds = np.bincount(kinds // BUCKETS, minlength=len(part))
            lists = ((n_terms, terms), (n_sentences, np.array(sizes, np.int32)), (n_kinds, (kinds % BUCKETS).astype(np.int32)), (n_kinds, counts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi], pa.int64()), pa.array(latin), *(pa.ListArray.from_arrays(_offsets(k), pa.array(v)) for k, v in lists)], ["doc_id", "latin", "terms", "sizes", "u", "n"]
            )
            lo = hi


@dataclass
class Space:
    """What the executors need to weigh and embed documents. Its size is bounded by BUCKETS * RANK."""

    index: np.ndarray  # bucket -> column, -1 for unused ones
    idf: np.ndarray
    basis: np.ndarray  # columns x RANK


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]


def weighted(b: pa.RecordBatch, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of a batch, rows of unit length, in row order."""
    u, starts = _lists(b.column("u"))
    n, _ = _lists(b.column("n"))
    row = np.repeat(np.arange(b.num_rows), np.diff(starts))
    col = space.index[u]
    keep = col >= 0
    row, col, n = row[keep], col[keep], n[keep]
    x = (1 + np.log(n)) * space.idf[col]
    norm = np.sqrt(np.bincount(row, x * x, b.num_rows))
    return row, col, (x / norm[row]).astype(np.float32)


def dense(row: np.ndarray, col: np.ndarray, x: np.ndarray, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, matrix) of a few documents at a time over the columns they use, for matrix products."""
    if not len(row):
        return
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    ends = np.append(heads[1:], len(row))
    stack = [(lo, min(lo + rows, len(heads))) for lo in range(0, len(heads), rows)][::-1]
    while stack:
        lo, hi = stack.pop()
        s = slice(heads[lo], ends[hi - 1])
        used, at = np.unique(col[s], return_inverse=True)
        if hi - lo > 1 and (hi - lo) * len(used) > BLOCK:
            mid = (lo + hi) // 2
            stack += [(mid, hi), (lo, mid)]
            continue
        m = np.zeros((hi - lo, len(used)), np.float32)
        m[np.repeat(np.arange(hi - lo), ends[lo:hi] - heads[lo:hi]), at] = x[s]
        yield row[heads[lo:hi]], used, m


def embed(b: pa.RecordBatch, space: Space) -> np.ndarray:
    """The rows of X Q of a batch."""
    out = np.zeros((b.num_rows, space.basis.shape[1]), np.float32)
    for rows, used, m in dense(*weighted(b, space)):
        out[rows] = m @ space.basis[used]
    return out


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _power(table: DataFrame, space: Space) -> np.ndarray:
    """X^T X Q, summed over tasks term by term. There are as many tasks as cores, so the sums that are sent do not grow
    with the documents."""
    k = space.basis.shape[1]
    context = table.sparkSession.sparkContext
    sent = context.broadcast(space)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        z, used = np.zeros(s.basis.shape, np.float32), np.zeros(len(s.basis), bool)
        for b in _small(batches):
            for _, cols, m in dense(*weighted(b, s)):
                z[cols] += m.T @ (m @ s.basis[cols])
                used[cols] = True
        at = np.flatnonzero(used)
        for lo in range(0, len(at), 4096):
            own = at[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), _list(list(z[own]), np.float32)], ["t", "z"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(sent.value.basis)
        z, used = np.zeros((size, k)), np.zeros(size, bool)
        for b in batches:
            t = b.column("t").to_numpy()
            np.add.at(z, t, _lists(b.column("z"))[0].reshape(-1, k))
            used[t] = True
        at = np.flatnonzero(used)
        for lo in range(0, len(at), 4096):
            own = at[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), _list(list(z[own]), np.float64)], ["t", "z"])

    sums = table.select("u", "n").coalesce(context.defaultParallelism).mapInArrow(part, "t int, z array<float>").repartition("t").mapInArrow(total, "t int, z array<double>").toArrow()
    sent.destroy()
    out = np.zeros(space.basis.shape)
    if sums.num_rows:  # at most BUCKETS rows
        out[sums.column("t").to_numpy()] = np.vstack(sums.column("z").to_numpy())
    return out


def fit_space(table: DataFrame, rank: int = RANK, passes: int = PASSES, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, seed: int = 7) -> Space | None:
    """Document frequencies and truncated singular value decomposition over all documents."""
    counts = table.select(F.explode("u").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()  # at most BUCKETS rows
    n = table.filter(F.size("u") > 0).count()
    counts = counts[(counts.df >= min_docs) & (counts.df <= max_share * n)].sort_values("t")
    if not len(counts):
        return None
    index = np.full(BUCKETS, -1, np.int32)
    index[counts.t] = np.arange(len(counts))
    idf = np.log(n / counts.df.to_numpy() + 1e-9)
    rank = min(rank, len(counts))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(counts), rank)))[0]
    for _ in range(passes - 1):
        q = np.linalg.qr(_power(table, Space(index, idf, q.astype(np.float32))))[0]
    g = q.T @ _power(table, Space(index, idf, q.astype(np.float32)))  # = (X q)^T (X q)
    value, vector = np.linalg.eigh((g + g.T) / 2)
    keep = value > 1e-6 * max(value.max(), 1e-12)
    return Space(index, idf, (q @ vector[:, keep][:, ::-1]).astype(np.float32))


@dataclass
class Subjects:
    """Centroids of subjects by script, the means they are taken from, and the fitted thresholds."""

    names: list[str]
    subject: np.ndarray  # index into names of each centroid
    latin: np.ndarray
    centroid: np.ndarray
    mean: np.ndarray  # of the documents labelled with no subject and, as a prior, of all: row 0 other scripts, row 1 Latin
    sentence: float = 0.0
    document: float = 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _sums(table: DataFrame, space: Space, pick, groups: int, extra: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of document embeddings over ``groups`` groups; pick(batch, embedding) gives (row, group) arrays."""
    k = space.basis.shape[1]
    context = table.sparkSession.sparkContext
    sent = context.broadcast(space)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = np.zeros((groups, k)), np.zeros(groups)
        for b in _small(batches):
            y = embed(b, sent.value)
            row, group = pick(b, y)
            np.add.at(s, group, y[row])
            c += np.bincount(group, minlength=groups)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), pa.array(c), _list(list(s), np.float64)], ["g", "c", "s"])

    rows = table.select("latin", "u", "n", *([extra] if extra else [])).mapInArrow(part, "g int, c double, s array<double>")
    # Summed on the executors: position by position, a few hundred numbers in all.
    summed = rows.select("g", "c", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"), F.sum("c").alias("c")).toPandas()
    sent.destroy()
    s, c = np.zeros((groups, k)), np.zeros(groups)
    s[summed.g, summed.i] = summed.v
    c[summed.g] = summed.c
    return s, c


def fit_subjects(table: DataFrame, space: Space, labels: DataFrame, areas: DataFrame, refinements: int = REFINEMENTS) -> Subjects:
    """Seed centroids from ``labels`` (doc_id, subject), refined over all documents."""
    names = [r.subject for r in areas.select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    at = {s: i for i, s in enumerate(names)}
    used = labels.filter(F.col("subject").isin(names)).select("doc_id", "subject").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(MAX_LABELS)
    code = F.element_at(F.create_map(*[F.lit(x) for kv in at.items() for x in kv]), F.col("subject"))
    seeds = table.select("doc_id", "latin", "u", "n").join(F.broadcast(used.select("doc_id", code.alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("s"))), "doc_id")  # at most MAX_LABELS rows
    script = lambda b, y: (np.arange(b.num_rows), b.column("latin").to_numpy(zero_copy_only=False).astype(int))
    sums, counts = _sums(table, space, script, 2)
    mean = sums / np.maximum(counts, 1)[:, None]
    width = len(names)
    plain = labels.groupBy("doc_id").agg(F.count("subject").alias("n")).filter("n = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    sums, counts = _sums(table.join(F.broadcast(plain.select("doc_id")), "doc_id", "left_semi"), space, script, 2)
    mean = (sums + PRIOR * mean) / (counts + PRIOR)[:, None]

    def labelled(b: pa.RecordBatch, y: np.ndarray):
        s, starts = _lists(b.column("s"))
        row = np.repeat(np.arange(b.num_rows), np.diff(starts))
        return row, s + width * b.column("latin").to_numpy(zero_copy_only=False).astype(int)[row]

    s, c = _sums(seeds, space, labelled, 2 * width, "s")
    have = np.flatnonzero(c > 0)
    out = Subjects(names, have % width, have // width, _unit(s[have] / c[have, None] - mean[have // width]), mean)

    for _ in range(refinements):
        now = out

        def nearest(b: pa.RecordBatch, y: np.ndarray, now=now):
            best, value = _nearest(b, y, now)
            row = np.flatnonzero(value >= CLOSE)
            return row, best[row]

        s, c = _sums(table, space, nearest, len(have)) if len(have) else (np.zeros((0, 1)), np.zeros(0))
        new = out.centroid.copy()
        ok = c > 0
        new[ok] = _unit(s[ok] / c[ok, None] - mean[out.latin[ok]])
        out = Subjects(names, out.subject, out.latin, new, mean)
    answers = used.select("doc_id", code.alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("s"))
    answers = answers.unionByName(plain.select("doc_id", F.array().cast("array<int>").alias("s")))
    out.sentence, out.document = _thresholds(table.join(F.broadcast(answers), "doc_id"), space, out)  # at most twice MAX_LABELS rows
    return out


def _similar(b: pa.RecordBatch, y: np.ndarray, s: Subjects) -> np.ndarray:
    """Cosine of each document with each centroid of its script; -1 elsewhere."""
    latin = b.column("latin").to_numpy(zero_copy_only=False).astype(int)
    cos = _unit(y - s.mean[latin]) @ s.centroid.T
    cos[latin[:, None] != s.latin[None]] = -1
    return cos


def _nearest(b: pa.RecordBatch, y: np.ndarray, s: Subjects) -> tuple[np.ndarray, np.ndarray]:
    cos = _similar(b, y, s)
    best = cos.argmax(1)
    return best, cos[np.arange(len(best)), best]


def _by_subject(cos: np.ndarray, s: Subjects) -> np.ndarray:
    """The best cosine of each subject over its centroids."""
    out = np.full((len(cos), len(s.names)), -1.0)
    for c, v in enumerate(cos.T):
        out[:, s.subject[c]] = np.maximum(out[:, s.subject[c]], v)
    return out


def sentence_cosines(b: pa.RecordBatch, space: Space, s: Subjects) -> tuple[np.ndarray, np.ndarray]:
    """(row of each sentence, sentences x subjects): cosines of the sentences' embeddings to the centroids of the
    document's script. A term counts once for each time it occurs; sentences without known terms are similar to nothing."""
    flat, _ = _lists(b.column("terms"))
    sizes, starts = _lists(b.column("sizes"))
    doc = np.repeat(np.arange(b.num_rows), np.diff(starts))
    col = space.index[flat]
    known = col >= 0
    of = np.repeat(np.arange(len(sizes)), sizes)[known]
    y = np.zeros((len(sizes), space.basis.shape[1]), np.float32)
    if len(of):
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        y[of[heads]] = np.add.reduceat(space.basis[col[known]] * space.idf[col[known], None].astype(np.float32), heads)
    script = b.column("latin").to_numpy(zero_copy_only=False).astype(int)[doc]
    some = np.linalg.norm(y, axis=1) > 0
    cos = _unit(_unit(y) - s.mean[script]) @ s.centroid.T
    cos[(script[:, None] != s.latin[None]) | ~some[:, None]] = -1
    return doc, _by_subject(cos, s)


def _dealt(cos: np.ndarray, doc: np.ndarray, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(share of each document's sentences that deal with each subject, whether enough of them do to count)."""
    n = np.bincount(doc, minlength=rows)
    hits = np.zeros((rows, cos.shape[1]))
    np.add.at(hits, doc, cos >= threshold)
    return hits / np.maximum(n, 1)[:, None], (hits >= np.minimum(2, np.maximum(n, 1))[:, None]) & (hits > 0)


def _thresholds(labelled: DataFrame, space: Space, subjects: Subjects) -> tuple[float, float]:
    """The thresholds of sentences and documents, of all in the grids, whose assignments agree best with the labels: the
    highest F1 over all pairs of a labelled document and a subject, ties by the higher thresholds."""
    context = labelled.sparkSession.sparkContext
    sent = context.broadcast((space, subjects))
    size = (len(SENTENCE_GRID), len(DOCUMENT_GRID))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, su = sent.value
        found, right, asked = np.zeros(size), np.zeros(size), 0
        for b in _small(batches):
            truth = np.zeros((b.num_rows, len(su.names)), bool)
            s, starts = _lists(b.column("s"))
            truth[np.repeat(np.arange(b.num_rows), np.diff(starts)), s] = True
            asked += int(truth.sum())
            own = _by_subject(_similar(b, embed(b, sp), su), su)
            doc, cos = sentence_cosines(b, sp, su)
            for i, t in enumerate(SENTENCE_GRID):
                share, enough = _dealt(cos, doc, b.num_rows, t)
                for j, d in enumerate(DOCUMENT_GRID):
                    ok = enough & (share >= SHARE) & (own >= d)
                    found[i, j] += ok.sum()
                    right[i, j] += (ok & truth).sum()
        at = np.arange(found.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found.ravel()), pa.array(right.ravel()), pa.array(np.full(found.size, float(asked)))], ["at", "found", "right", "asked"])

    rows = labelled.select("latin", "terms", "sizes", "u", "n", "s").mapInArrow(count, "at int, found double, right double, asked double")
    total = rows.groupBy("at").agg(F.sum("found").alias("found"), F.sum("right").alias("right"), F.sum("asked").alias("asked")).toPandas()  # as many rows as the grid has
    sent.destroy()
    if not len(total):
        return SENTENCE_GRID[-1], DOCUMENT_GRID[-1]
    total["f1"] = (2 * total.right / (total.found + total.asked).clip(lower=1)).round(9)
    best = int(total.sort_values(["f1", "at"]).iloc[-1]["at"])
    return SENTENCE_GRID[best // size[1]], DOCUMENT_GRID[best % size[1]]


def shares(table: DataFrame, space: Space, subjects: Subjects) -> DataFrame:
    """(doc_id, subject, share): the share of the document's sentences that deal with the subject, for the subjects
    that are similar to the document and that two of its sentences (or its only one) deal with."""
    sent = table.sparkSession.sparkContext.broadcast((space, subjects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, su = sent.value
        for b in _small(batches):
            own = _by_subject(_similar(b, embed(b, sp), su), su)
            doc, cos = sentence_cosines(b, sp, su)
            share, enough = _dealt(cos, doc, b.num_rows, su.sentence)
            row, subject = np.nonzero(enough & (own >= su.document))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array([su.names[i] for i in subject], pa.string()), pa.array(share[row, subject])], ["doc_id", "subject", "share"]
            )

    return table.mapInArrow(run, "doc_id bigint, subject string, share double")


def subject_shares(documents: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", mend: bool = True) -> DataFrame:
    """(doc_id, subject, share) for all documents. Null ids and texts take no part; a document without sentences of
    at least MIN_WORDS words has no rows; without labels or documents there are no rows; repeated label rows count
    once; labels of unknown documents or subjects are passed over. Without ``mend`` the texts are taken as repaired."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    table = runtime.table((repaired(docs) if mend else docs).mapInArrow(_terms, TERMS))
    space = fit_space(table)
    if space is not None:
        subjects = fit_subjects(table, space, labels, areas)
        if len(subjects.subject):
            return shares(table, space, subjects)
    return spark.createDataFrame([], "doc_id bigint, subject string, share double")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    return subject_shares(read("documents"), read("subject_labels"), read("subject_areas")).filter(F.col("share") >= SHARE)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).select("doc_id", "subject").distinct()


def p9_makeup(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by subject: documents, and characters as the documents' shares of sentences give them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.length("text").alias("n"))
    found = _found(spark, sf)
    by = found.join(docs, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum(F.col("share") * F.col("n"))).cast("bigint").alias("n_chars"))
    rest = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.lit(None).cast("string").alias("subject"), F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_chars"))
    return by.unionByName(rest)


QUERIES = {"p9_found": p9_found, "p9_makeup": p9_makeup}
SQL: dict[str, str] = {}
