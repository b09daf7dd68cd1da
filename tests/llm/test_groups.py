import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import groups


def components(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(p)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "cycle"])
def test_components(spark, shape):
    r = random.Random(3)
    n = 60
    ids = r.sample(range(1000), n)
    edges = {"chain": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]], "random": [(r.choice(ids), r.choice(ids)) for _ in range(40)], "cycle": list(zip(ids, [*ids[1:], ids[0]]))}[shape]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (5000, 5000)], "a long, b long")
    assert {tuple(x) for x in groups.hash_to_min(df).collect()} == components(edges)


def test_no_edges(spark):
    assert groups.hash_to_min(spark.createDataFrame([], "a long, b long")).count() == 0


def test_related(spark):
    rows = [(1, "s1", None, "یک"), (2, "s1", "r1", "دو"), (3, None, "r1", "سه"), (4, "unknown", None, "این جمله بسیار بلند است"), (5, "", None, "این جمله، بسیار بلند است!"), (6, None, None, "بله"), (7, None, None, "بله"), (8, "unknown", None, None), (8, "unknown", None, None), (None, "s1", "r1", "x"), (9, " unknown", None, "")]
    df = spark.createDataFrame(rows, "id long, speaker_id string, recording_id string, cleaned_text string").withColumn("k", F.lit(1))
    assert {tuple(x) for x in groups.related(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    out = {r.id: (r.group_id, r.split) for r in groups.split_of_records(df).collect()}
    assert set(out) == set(range(1, 10)) and len({out[i] for i in (1, 2, 3)}) == 1 and out[6][0] == 6
    assert groups.split_of_records(df.limit(0)).count() == 0


def test_shares(spark):
    g = spark.createDataFrame([(i, 3) for i in range(4000)] + [(10_000, 5000), (10_001, 900)], "group_id long, n long")
    out = groups.assign(g)
    total = 12_000 + 5900
    by = {r.split: r.n for r in out.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert out.count() == 4002 and abs(by["train"] / total - 0.8) < 0.02 and abs(by["test"] / total - 0.1) < 0.02
    again = {r.group_id: r.split for r in groups.assign(g.repartition(5)).collect()}
    assert again == {r.group_id: r.split for r in out.collect()}
    with pytest.raises(ValueError, match="weights"):
        groups.assign(g, {"a": 0.0})


def test_one_rule_for_all_sizes(spark):
    """A quarter of all records in one group never goes to a split that it would overfill, and the rest makes up for it."""
    for big in range(6):
        g = spark.createDataFrame([(i, 1 + i % 5) for i in range(3000)] + [(10_000 + big, 3000), (20_000, 600)], "group_id long, n long")
        out = groups.assign(g).groupBy("split").agg(F.sum("n").alias("n")).collect()
        whole = sum(r.n for r in out)
        assert all(abs(r.n / whole - groups.SPLITS[r.split]) < 0.01 for r in out) and len(out) == 3
    one = groups.assign(spark.createDataFrame([(1, 5)], "group_id long, n long")).collect()
    assert [r.split for r in one] == ["train"]
    assert groups.assign(one and spark.createDataFrame([], "group_id long, n long")).count() == 0


def test_rounds_shrink(spark, monkeypatch):
    """Nodes with one edge retire at once: a star takes one round, whatever its size, and a chain a logarithm."""
    from corpusloom import runtime

    sizes = []
    monkeypatch.setattr(runtime, "table", lambda df, table=runtime.table: (sizes.append(1), table(df))[1])
    star = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert groups.hash_to_min(star).filter("group_id <> 0").count() == 0 and len(sizes) <= 4
    sizes.clear()
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert groups.hash_to_min(chain).filter("group_id <> 0").count() == 0 and len(sizes) < 64


def test_rendezvous_moves_little(spark):
    df = spark.range(4000)
    a = {r.id: r.s for r in df.select("id", groups.rendezvous(F.col("id"), {"x": 0.5, "y": 0.5}).alias("s")).collect()}
    b = {r.id: r.s for r in df.select("id", groups.rendezvous(F.col("id"), {"x": 0.5, "y": 0.5, "z": 0.25}).alias("s")).collect()}
    assert all(b[i] in (a[i], "z") for i in a)
    assert abs(sum(v == "z" for v in b.values()) / 4000 - 0.2) < 0.03


def test_whole_tables(spark, sf):
    got = {r.id: r.split for r in groups.p5_splits(spark, sf).collect()}
    pairs = groups.p5_found(spark, sf).collect()
    assert len(got) == groups.clips_of(spark, sf).select("id").distinct().count()
    assert all(got[r.id] == got[r.group_id] for r in pairs)
