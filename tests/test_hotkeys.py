from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import hotkeys
from corpusloom.operators.hotkeys import count_rows, greatest, heavy_keys, least, total, tree_aggregate


def test_tree_equals_plain_counts(spark):
    data = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 50}", i % 7) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, k string, v int").repartition(13)
    want = Counter(k for _, k, _ in data)
    for fan_in, chunk in ((2, 7), (3, 100), (32, 1), (16, 100_000)):
        out = tree_aggregate(df, {"k": F.col("k")}, [count_rows(), least(F.col("id"), "lo"), greatest(F.col("id"), "hi"), total(F.col("v"), "s")], fan_in, chunk)
        got = {r.k: (r.n_rows, r.lo, r.hi, r.s) for r in out.collect()}
        assert {k: v[0] for k, v in got.items()} == dict(want)
        assert got["hot"] == (want["hot"], min(i for i, k, _ in data if k == "hot"), max(i for i, k, _ in data if k == "hot"), sum(v for _, k, v in data if k == "hot"))


def rounds(df, *args):
    plan = tree_aggregate(df, {"k": F.col("k")}, [count_rows()], *args)._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(k")


def test_rounds_follow_the_rows(spark, tmp_path):
    """One split of many rows has as many leaves as its chunks: 27 -> 9 -> 3 -> 1."""
    spark.range(2700).coalesce(1).write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x").withColumn("k", F.col("id") % 2)
    assert rounds(df, 3, 100) == 3 and rounds(df, 3, 300) == 2 and rounds(df, 32, 100) == 1 and rounds(df, 2, 100) == 5
    assert rounds(spark.range(54).repartition(27).withColumn("k", F.col("id") % 2), 3, 100) == 3


def test_no_node_receives_more_than_its_fan_in(spark):
    """Leaves are runs of rows: a node merges at most fan_in of them."""
    df = spark.range(1000).coalesce(1).withColumn("k", F.lit("a"))
    size = hotkeys.measured(df)
    assert size == hotkeys.Size(1, 1000, 1000)
    wrong = hotkeys.Size(3, 20, 60)  # a wrong size changes the balance only
    assert tree_aggregate(df, {"k": F.col("k")}, [count_rows()], 4, 10, wrong).first().n_rows == 1000


def test_text_of_the_key_comes_along(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "t string, v int")
    out = tree_aggregate(df, {"k": F.md5("t")}, [hotkeys.any_of(F.col("t"), "text"), count_rows()], 2, 1)
    assert {(r.text, r.n_rows) for r in out.collect()} == {("a", 2), (None, 1)}


def test_heavy_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",)] * 2, "k string")
    per = tree_aggregate(df, {"k": F.col("k")}, [count_rows()])
    assert {r.k for r in heavy_keys(per, "n_rows", 0.02).collect()} == {"a", "b"}
    assert {r.k for r in heavy_keys(per, "n_rows", 0.03).collect()} == {"a"}
    assert tree_aggregate(df.limit(0), {"k": F.col("k")}, [count_rows()]).count() == 0
    clash = df.withColumn("n_rows", F.lit(1)).withColumn("__x", F.lit(2))
    assert {tuple(r) for r in tree_aggregate(clash, {"k": F.col("k")}, [count_rows()]).collect()} == {("a", 98), ("b", 2)}
