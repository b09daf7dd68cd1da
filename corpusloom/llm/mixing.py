"""Mixing sources to target weights (problem 8): raking and calibrated sampling.

The size of a document is its number of tokens under a public tokenizer. Token totals of the cells (source,
language, topic) are raked by iterative proportional fitting: expected copies of the cells are scaled to the
topic, language and source marginals in turn, within each source's cap of repeats, until they settle; the
source marginal is fitted last and exactly wherever the cap allows. Each document of a cell of weight w is then
taken floor(w) times, and once more when its hash falls below a threshold that is calibrated on the hash
histogram of the cell's tokens, so that the cell's tokens meet w. Nothing is ordered or gathered: one pass
counts tokens, one builds the histogram, one takes the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.subjects import SHARE, mostly_latin, repaired, subject_shares

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 200_000
ROUNDS, SETTLED = 500, 1e-10
BINS = 1024
MAX_CELLS = 100_000


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """A very long text in parts that tokenize alike alone: cut where a letter follows a single space."""
    at = 0
    while len(text) - at > long:
        cut = at + long
        while cut > at + 1 and not (text[cut] == " " and text[cut + 1 : cut + 2].isalpha() and not text[cut - 1].isspace()):
            cut -= 1
        if cut == at + 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(documents: DataFrame, text: str, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id",), stored: str | None = None) -> DataFrame:
    """``keep`` plus n_tokens and latin (whether most visible characters are Latin letters). Null texts have no tokens.
    Where the column ``stored`` is not null, its text is the one that is counted."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # the vocabulary file, about 1 MB
    df = documents.select(*keep, F.col(text).alias("__text"), (F.col(stored) if stored else F.lit(None).cast("string")).alias("__stored"))
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    schema = StructType([*df.select(*keep).schema.fields, StructField("n_tokens", LongType()), StructField("latin", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n, latin = [], []
            for t, own in zip(b.column("__text").to_pylist(), b.column("__stored").to_pylist(), strict=True):
                t = t or ""
                n.append(sum(len(enc.encode_ordinary(p)) for p in pieces(t if own is None else own)))
                latin.append(mostly_latin(t))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(latin)], [*keep, "n_tokens", "latin"])

    return df.mapInArrow(run, schema)


def rake(cells: pd.DataFrame, source: dict[str, tuple[float, int]], total: float | None = None, others: dict[str, dict] | None = None) -> pd.DataFrame:
    """``cells`` (source, ..., n_tokens) plus weight, the expected copies of each document of the cell.

    ``source``: target share and cap of each source. ``others``: for further columns the target share of each
    value; by default the corpus's own. ``total`` tokens are aimed at, by default the most at which every source
    that has documents reaches its share within its cap. Sources without tokens leave the shares of the others
    in proportion. Zero-token cells get weight 0. ``attrs`` of the result: ``settled``, whether the weights came to
    rest within ROUNDS rounds, ``rounds``, and ``aims``, the share of all tokens aimed at by (column, value). Caps may
    keep topic and language marginals from their aims; then the source marginal holds and the weights still settle.
    """
    cells = cells[cells.source.isin(source)].reset_index(drop=True).copy()
    x = cells.n_tokens.to_numpy(float)
    have = {s: x[(cells.source == s).to_numpy()].sum() for s in source}
    live = {s: source[s] for s in source if have[s] > 0 and source[s][0] > 0}
    if not live:
        cells["weight"] = 0.0
        cells.attrs.update(settled=True, rounds=0, aims={})
        return cells
    whole = sum(t for t, _ in live.values())
    most = min(have[s] * cap * whole / t for s, (t, cap) in live.items())
    total = most if total is None else min(total, most)
    cap = cells.source.map({s: (c if s in live else 0) for s, (_, c) in source.items()}).to_numpy(float)
    rows = {s: np.flatnonzero((cells.source == s).to_numpy() & (x > 0)) for s in live}
    targets, aims = [], {("source", s): t / whole for s, (t, _) in live.items()}
    for column in [c for c in cells.columns if c not in ("source", "n_tokens")]:
        own = cells.groupby(column, dropna=False).n_tokens.sum()
        given = (others or {}).get(column) or own.to_dict()
        given = {k: v for k, v in given.items() if own.get(k, 0) > 0}
        s = sum(given.values()) or 1
        aims |= {(column, k): v / s for k, v in given.items()}
        targets.append([(np.flatnonzero(((cells[column] == k) | (cells[column].isna() & pd.isna(k))).to_numpy() & (x > 0)), v / s * total) for k, v in given.items()])
    w = np.where(x > 0, np.minimum(cap, 1.0), 0.0)
    settled, rounds = False, 0
    while not settled and rounds < ROUNDS:
        rounds += 1
        before = w.copy()
        for marginal in targets:
            for own, aim in marginal:
                held = (w[own] * x[own]).sum()
                if held > 0:
                    w[own] = np.minimum(cap[own], w[own] * aim / held)
        for s, (t, _) in live.items():
            own, aim = rows[s], t / whole * total
            for _ in range(len(own) + 1):  # cells at their cap stay there, the others take up the rest
                free = own[w[own] < cap[own] - 1e-12]
                held, fixed = (w[free] * x[free]).sum(), (w[own] * x[own]).sum()
                gap = aim - (fixed - held)
                if abs(fixed - aim) <= 1e-12 * aim or (fixed < aim and not len(free)):
                    break
                if fixed > aim:
                    w[own] *= aim / fixed
                    break
                w[free] = np.minimum(cap[free], w[free] * gap / held) if held > 0 else np.minimum(cap[free], gap / x[free].sum())
        settled = bool(np.abs(w - before).max() <= SETTLED * max(1.0, w.max()))
    cells["weight"] = w
    cells.attrs.update(settled=settled, rounds=rounds, aims=aims)
    return cells


def _draw(key: Column, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double")) / float(1 << 53)


def planned(sized: DataFrame, targets: DataFrame, dims: tuple[str, ...] = ("language", "topic"), total: float | None = None, others: dict[str, dict] | None = None) -> tuple[DataFrame, pd.DataFrame]:
    """(the documents that may be taken, the raked cells)."""
    source = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.filter("source IS NOT NULL").collect()}
    usable = sized.filter(F.col("source").isin(list(source)) & (F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
    cells = usable.groupBy("source", *dims).agg(F.sum("n_tokens").alias("n_tokens")).limit(MAX_CELLS + 1).toPandas()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells: use coarser languages or topics")
    return usable, rake(cells, source, total, others)


def mixture(sized: DataFrame, targets: DataFrame, dims: tuple[str, ...] = ("language", "topic"), total: float | None = None, others: dict[str, dict] | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, *dims, n_tokens, copies) of the documents taken at least once.

    ``sized``: doc_id, source, *dims, n_tokens. Documents of a null source or one without a target, and those
    without tokens, are not taken; null dims form values of their own; an empty table gives no rows; repeated
    rows of one doc_id are taken alike.
    """
    spark = sized.sparkSession
    columns = ["source", *dims]
    out = [*("doc_id", "source"), *dims, "n_tokens"]
    usable, raked = planned(sized, targets, dims, total, others)
    if not len(raked):
        return usable.select(*out, F.lit(0).alias("copies"))
    text = "source string, " + "".join(f"{d} string, " for d in dims) + "need double, base int, weight double"
    raked["base"] = np.floor(raked.weight + 1e-9).astype(int)
    raked["need"] = np.maximum(0.0, raked.weight - raked.base) * raked.n_tokens
    plan = [tuple(None if not isinstance(v, (str, int, float)) or v != v else v for v in r) for r in raked[[*columns, "need", "base", "weight"]].itertuples(index=False, name=None)]
    plan = spark.createDataFrame([(*r[: len(columns)], float(r[-3]), int(r[-2]), float(r[-1])) for r in plan], text)  # at most MAX_CELLS rows
    drawn = usable.select(*out, _draw(F.col("doc_id"), seed).alias("u"))
    bins = drawn.groupBy(*columns, F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*columns).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in columns]
    cum = bins.withColumn("before", before)
    at = cum.join(runtime.broadcast_if_small(plan), same(cum, plan)).filter("need > 0 AND before < need AND before + t >= need - 1e-6")
    cut = at.groupBy(*[cum[c] for c in columns]).agg(F.max((F.col("bin") + (F.col("need") - F.col("before")) / F.col("t")) / BINS).alias("cut"))
    cut = runtime.table(plan.join(cut, same(plan, cut), "left").select(*[plan[c].alias(f"__{c}") for c in columns], "base", "weight", F.coalesce("cut", F.lit(0.0)).alias("cut")))
    taken = drawn.join(runtime.broadcast_if_small(cut), [drawn[c].eqNullSafe(cut[f"__{c}"]) for c in columns])
    return taken.withColumn("copies", F.col("base") + F.when(F.col("u") < F.col("cut"), 1).otherwise(0)).filter("copies > 0").select(*out, "copies")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: target and actual share of all tokens, documents, copies and tokens taken."""
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    by = runtime.table(by)
    whole = by.agg(F.sum("n_tokens")).scalar()
    nil = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.join(by, "source", "left").select("source", "target_share", F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)).alias("actual_share"), "max_repeats", *map(nil, ("most_copies", "n_docs", "n_copies", "n_tokens")))


def marginals(mixed: DataFrame, sized: DataFrame, targets: DataFrame, dims: tuple[str, ...] = ("language", "topic"), others: dict[str, dict] | None = None) -> DataFrame:
    """(dimension, value, target_share, reached_share, settled): the share of all tokens of each source, and of each value
    of the dimensions, that was aimed at and that the mixture has, and whether the raking settled."""
    _, raked = planned(sized, targets, dims, None, others)
    aims = [(c, None if pd.isna(v) else v, float(x)) for (c, v), x in raked.attrs["aims"].items()]
    spark = mixed.sparkSession
    aims = spark.createDataFrame(aims, "dimension string, value string, target_share double")  # as many rows as values
    tokens = F.sum(F.col("copies") * F.col("n_tokens"))
    cells = runtime.table(mixed.groupBy("source", *dims).agg(tokens.alias("t")))
    whole = cells.agg(F.sum("t")).first()[0] or 1
    held = reduce(DataFrame.unionByName, [cells.groupBy(F.col(c).alias("value")).agg((F.sum("t") / whole).alias("reached")).select(F.lit(c).alias("dimension"), "value", "reached") for c in ("source", *dims)])
    same = (aims.dimension == held.dimension) & aims.value.eqNullSafe(held.value)
    return aims.join(held, same, "left").select(aims.dimension, aims.value, "target_share", F.coalesce("reached", F.lit(0.0)).alias("reached_share"), F.lit(bool(raked.attrs["settled"])).alias("settled"))


def conservation(mixed: DataFrame, sized: DataFrame, targets: DataFrame, most_off: float = 0.05) -> DataFrame:
    """One row: documents taken more often than their source allows, taken from no source of the targets, taken in more
    than one row, taken with another size than they have; and sources that are further from their share than ``most_off``."""
    caps = F.broadcast(targets.select(F.col("source").alias("s"), "max_repeats"))  # as many rows as sources
    rows = mixed.join(caps, F.col("source") == F.col("s"), "left")
    sizes = mixed.select("doc_id", F.col("n_tokens").alias("taken")).join(sized.select("doc_id", "n_tokens").distinct(), "doc_id")
    repeated = mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_documents"))
    counted = rows.agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("s").isNull()).alias("foreign_source"))
    changed = sizes.agg(F.count_if(F.col("taken") != F.col("n_tokens")).alias("changed_sizes"))
    off = marginals(mixed, sized, targets).filter("dimension = 'source'").agg(F.count_if(F.abs(F.col("reached_share") - F.col("target_share")) > most_off).alias("sources_off"))
    return reduce(lambda x, y: x.join(F.broadcast(y), how="cross"), [counted, repeated, changed, off])  # one row each


def language(tag: Column, latin: Column, scripts: tuple[str, str]) -> Column:
    """The language tag without its region. ``scripts``: the languages of a text in Latin letters and of one in others;
    the first goes for every text in Latin letters, the second for others whose tag is missing or names the first."""
    plain = F.lower(F.split(F.trim(tag), "[-_]")[0])
    return F.when(latin, F.lit(scripts[0])).when(plain.isNull() | plain.isin(scripts[0], ""), F.lit(scripts[1])).otherwise(plain)


def sized_documents(documents: DataFrame, areas: DataFrame, tokenizer: str = TOKENIZER, scripts: tuple[str, str] = ("en", "fa")) -> DataFrame:
    """Documents of a source with tokens, language and topic, by ``areas`` (doc_id, subject, share): their largest
    subject, or none. ``documents``: doc_id, source, lang, text (repaired) and stored, see :func:`subjects.repaired`."""
    counted = token_counts(documents.filter(F.col("source").isNotNull()), "text", tokenizer, ("doc_id", "source", "lang"), "stored")
    counted = counted.select("doc_id", "source", language(F.col("lang"), F.col("latin"), scripts).alias("language"), "n_tokens")
    topic = areas.groupBy("doc_id").agg(F.max_by("subject", F.struct("share", "subject")).alias("topic"))
    return runtime.table(counted.join(topic, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("none"))))


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    documents = repaired(read("documents").select("doc_id", "source", "lang", "text"), stored="stored")
    areas = subject_shares(documents, read("subject_labels"), read("subject_areas"), mend=False).filter(F.col("share") >= SHARE)
    return sized_documents(documents, areas), read("mix_targets")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(*_inputs(spark, sf))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _inputs(spark, sf)
    return share_report(mixture(sized, targets), targets)


def p8_marginals(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _inputs(spark, sf)
    return marginals(mixture(sized, targets), sized, targets)


def p8_conservation(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = _inputs(spark, sf)
    return conservation(runtime.table(mixture(sized, targets)), sized, targets)


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_marginals": p8_marginals, "p8_conservation": p8_conservation}
SQL = {"p8_conservation": "SELECT 0::BIGINT AS over_cap, 0::BIGINT AS foreign_source, 0::BIGINT AS repeated_documents, 0::BIGINT AS changed_sizes, 0::BIGINT AS sources_off"}
