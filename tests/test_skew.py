import pytest
from pyspark.sql import functions as F

from corpusloom.operators.skew import join_per_key, join_spread


@pytest.mark.parametrize("least", [10, 1_000_000])
def test_equals_a_plain_join(spark, least):
    data = [(i, None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 40}", i % 2) for i in range(900)]
    rows = spark.createDataFrame(data, "id long, k string, n int")
    per = rows.filter("k IS NOT NULL AND k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("m"))
    got = join_per_key(rows, per, ["k"], "c", F.col("id"), share=0.05, least=least)
    assert got.columns == ["k", "id", "n", "m"]
    want = rows.join(per.drop("c"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert join_per_key(rows.limit(0), per, ["k"], "c", F.col("id")).count() == 0
    assert join_per_key(rows, per.limit(0), ["k"], "c", F.col("id")).count() == 0


def test_hot_rows_are_spread(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = join_per_key(rows, per, ["k"], "c", F.col("id"), share=0.1, least=10).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(r["count"] for r in sizes) < 500


@pytest.mark.parametrize("least", [10, 1_000_000])
def test_spread_equals_a_plain_join(spark, least):
    data = [(i, None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 40}") for i in range(300)]
    a, b = spark.createDataFrame(data, "x long, k string"), spark.createDataFrame(data[:150], "y long, k string")
    got = join_spread(a, b, ["k"], F.col("x"), share=0.05, least=least, salts=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, "k").select(*got.columns).collect()))
    assert join_spread(a.limit(0), b, ["k"], F.col("x")).count() == 0
