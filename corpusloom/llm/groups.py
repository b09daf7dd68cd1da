"""Splits that keep related records together (problem 5).

Records are linked through shared keys (speaker, recording, sentence). Each key gives a star of edges to the
smallest id that holds it, so the edges are linear in the records whatever the size of a key. Components are
found by hash-to-min on rows: a node's cluster is its edges; in each round every node sends its cluster to the
cluster's minimum, and the minimum to every member of the cluster. Two kinds of round take turns. In the one every
member is replaced by its own minimum as its cluster is handed over, so that only minima stay; this shrinks the graph
fastest. In the other members stay, and the minimum spreads along chains of minima. A node that no edge names any
more has retired, remembering its minimum; a round handles only what is still growing, and the last finds no edges.
Components then go to splits by weighted rendezvous hashing of their smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm.dress import text_digests
from corpusloom.operators.skew import join_per_key

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
MIN_LETTERS = 15
NOBODY = ("", "unknown")
MAX_ROUNDS = 64
#: Passes over the groups in which the weights are fitted, and the error of a share that ends them.
PASSES, CLOSE = 12, 0.002


def links(members: DataFrame) -> DataFrame:
    """(a, b): edges a > b between an ``id`` and the smallest id that holds the same key ``k``.

    Null ids and null keys link nothing. The minimum is taken with map-side combine, and the join back spreads hot
    keys, so a key of a third of all rows is no burden. ``members`` is evaluated once.
    """
    held = runtime.table(members.filter("id IS NOT NULL AND k IS NOT NULL").select("id", "k"))
    least = held.groupBy("k").agg(F.min("id").alias("b"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("last > b").drop("last")
    return join_per_key(held, runtime.table(least), ["k"], "n", F.col("id")).filter("id > b").select(F.col("id").alias("a"), "b")


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, group_id): the smallest node of the component of each node that has an edge. No edges, no rows.

    A cluster is never gathered in one task: it is spread over rows, and only its minimum is aggregated. Edges are
    kept once, as (hi, lo). Joins to a node's row spread the nodes that hold many edges.
    """
    x, y = F.col(a), F.col(b)
    e = runtime.table(edges.filter((x != y) & x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct())
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components are not stable after {max_rounds} rounds")
        ends = F.explode(F.array(F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")), F.struct(F.col("lo").alias("v"), F.col("hi").alias("u"))))
        node = runtime.table(e.select(ends.alias("x")).groupBy("x.v").agg(F.least(F.min("x.u"), F.first("x.v")).alias("m"), F.count(F.lit(1)).alias("n")))
        # A node with one edge, to a smaller one, has nothing more to say: its edge goes.
        leaf = (F.col("n") == 1) & (F.col("m") < F.col("v"))
        upper = (node.filter(~leaf) if len(rounds) % 2 else node).select(F.col("v").alias("hi"), F.col("m").alias("mh"), "n")
        lower = node.select(F.col("v").alias("lo"), F.col("m").alias("ml"), "n")
        live = join_per_key(join_per_key(e, upper, ["hi"], "n", F.col("lo")), lower, ["lo"], "n", F.col("hi"))
        pairs = (("lo", "mh"), ("hi", "mh"), ("hi", "ml"), ("lo", "ml")) if len(rounds) % 2 else (("mh", "ml"),)
        sent = F.explode(F.array(*[F.struct(F.greatest(p, q).alias("hi"), F.least(p, q).alias("lo")) for p, q in pairs]))
        grown = runtime.table(live.select(sent.alias("x")).select("x.hi", "x.lo").filter("hi > lo").distinct())
        runtime.release(e)
        rounds.append(node)
        e = grown
    return _resolved(rounds, edges.sparkSession)


def _resolved(rounds: list[DataFrame], spark: SparkSession) -> DataFrame:
    """Labels of the nodes that retired in each round, from the last round to the first: the label of their minimum
    where that retired later, else the minimum itself, which is the smallest node of its component."""
    done: DataFrame | None = None
    for k in reversed(range(len(rounds))):
        gone = rounds[k].filter("m < v").select("v", "m")
        if done is None:
            done = gone.select(F.col("v").alias("id"), F.col("m").alias("group_id"))
            continue
        gone = gone.join(rounds[k + 1].select("v"), "v", "left_anti")
        known = done.select(F.col("id").alias("m"), "group_id")
        target = gone.groupBy("m").agg(F.count(F.lit(1)).alias("n")).join(known, "m", "left").select("m", "n", F.coalesce("group_id", "m").alias("group_id"))
        labels = join_per_key(gone, runtime.table(target), ["m"], "n", F.col("v")).select(F.col("v").alias("id"), "group_id")
        done = runtime.table(done.unionByName(labels))
    if done is None:
        return spark.createDataFrame([], "id bigint, group_id bigint")
    return done.unionByName(done.select(F.col("group_id").alias("id"), "group_id").distinct())


def _draw(group: Column, split: str, seed: int) -> Column:
    """A number in (0, 1) for each group and split."""
    return (F.shiftrightunsigned(F.xxhash64(group, F.lit(split), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def rendezvous(group: Column, weights: dict[str, float], seed: int = 42, fits: dict[str, Column] | None = None) -> Column:
    """The split of highest score -weight / ln(draw): each split gets its weight's share of the groups, and
    changing one weight moves only groups to or from that split. ``fits``: whether a split takes part."""
    score = lambda s, w: -F.lit(float(w)) / F.ln(_draw(group, s, seed))
    scores = [F.struct(F.when(fits[s] if fits else F.lit(True), score(s, w)).otherwise(0.0).alias("score"), F.lit(s).alias("split")) for s, w in weights.items() if w > 0]
    return F.array_max(F.array(*scores))["split"]


def assign(groups: DataFrame, splits: dict[str, float] = SPLITS, seed: int = 42, passes: int = PASSES, close: float = CLOSE) -> DataFrame:
    """(group_id, n, split) for ``groups`` (group_id, n records). No group is divided.

    One rule for groups of any size: rendezvous hashing among the splits whose whole share of the records is not
    less than the group (a group larger than all shares goes to the largest). The weights of the hashing are fitted
    so that the records, not the groups, come in the given shares: each pass sums the records of each split under
    the present weights and moves these towards the shares; the weights of the closest pass count. An empty input
    gives no rows.
    """
    if not splits or any(w < 0 for w in splits.values()) or sum(splits.values()) <= 0:
        raise ValueError("splits need weights of at least 0, not all 0")
    whole = groups.agg(F.sum("n")).first()[0] or 0
    aim = {s: w / sum(splits.values()) for s, w in splits.items() if w > 0}
    largest = max(aim, key=lambda s: aim[s])
    fits = {s: F.lit(True) if s == largest else F.col("n") <= F.lit(w * whole) for s, w in aim.items()}
    weights, best = dict(aim), (2.0, dict(aim))
    for k in range(passes if whole else 0):
        held = {r.split: r.n / whole for r in groups.groupBy(rendezvous(F.col("group_id"), weights, seed, fits).alias("split")).agg(F.sum("n").alias("n")).collect()}
        error = max(abs(held.get(s, 0.0) - w) for s, w in aim.items())
        best = min(best, (error, dict(weights)), key=lambda x: x[0])
        if error <= close:
            break
        pace = 1.0 / (1 + k / 4)
        weights = {s: v * min(4.0, max(0.25, aim[s] / max(held.get(s, 0.0), 1e-9))) ** pace for s, v in weights.items()}
    return groups.select("group_id", "n", rendezvous(F.col("group_id"), best[1], seed, fits).alias("split"))


def keys_of(clips: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, k): the speaker, recording and sentence keys of clips; ``k`` is a digest of the kind and the key."""
    digest = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(kind), c)))
    speaker = F.when(~F.trim("speaker_id").isin(*NOBODY), digest("s", F.col("speaker_id")))
    named = clips.select("id", F.explode(F.array(speaker, digest("r", F.col("recording_id")))).alias("k"))
    texts = clips.select(F.lit("").alias("tab"), "id", F.col("cleaned_text").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return named.unionByName(text_digests(texts, min_letters))


def clips_of(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").select("id", "speaker_id", "recording_id", "cleaned_text")
    return read("train_clips").unionByName(read("val_clips"))


def related(clips: DataFrame) -> DataFrame:
    """(id, group_id) of the ids with at least one related other id."""
    return hash_to_min(links(keys_of(clips)))


def split_of_records(clips: DataFrame, splits: dict[str, float] = SPLITS, seed: int = 42) -> DataFrame:
    """(id, group_id, split) for every id, lone records as their own group."""
    ids = clips.filter("id IS NOT NULL").select("id").distinct()
    grouped = runtime.table(ids.join(related(clips), "id", "left").withColumn("group_id", F.coalesce("group_id", "id")))
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.join(assign(sizes, splits, seed).select("group_id", "split"), "group_id").select("id", "group_id", "split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return related(clips_of(spark, sf))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    return split_of_records(clips_of(spark, sf))


QUERIES = {"p5_found": p5_found, "p5_splits": p5_splits}
SQL: dict[str, str] = {}
