"""Shapes of physical plans that matter at size."""

import re

import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf):
    p = plan(entry.queries()["range_filter"](spark, sf))
    assert "GreaterThanOrEqual(duration,1.0), LessThanOrEqual(duration,30.0)" in p
    assert "ReadSchema: struct<id:bigint,duration:double>" in p and "Exchange" not in p


def test_audio_stays_in_the_scan(spark, sf):
    for name in ("shard_hashes", "wav_duration"):
        p = plan(entry.queries()[name](spark, sf))
        assert "Exchange" not in p and "audio:struct<bytes:binary>" in p


def test_long_arrays_are_spread_before_they_are_made(spark, sf):
    """A small table of long arrays is no single task, and no lambda is interpreted for each sample."""
    df = entry.queries()["clip_trim"](spark, sf)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    p = plan(df)
    assert p.index("MapInArrow") < p.index("Exchange RoundRobinPartitioning") < p.index("Scan parquet") and "lambda" not in p


def test_text_functions_need_no_python(spark, sf):
    for name in ("text_normalize", "number_words", "fingerprint", "text_sizes", "error_rates", "signal_stats", "peak_normalize"):
        p = plan(entry.queries()[name](spark, sf))
        assert "Python" not in p and "InArrow" not in p and "InPandas" not in p


def test_aggregates_combine_before_the_shuffle(spark, sf):
    for name in ("range_outliers", "rate_outliers", "p1_text_totals", "frequency_table"):
        assert "partial_" in plan(entry.queries()[name](spark, sf))


def test_no_cartesian_product(spark, sf):
    for name, query in entry.queries().items():
        if name.startswith("p1_") or not re.match(r"p\d", name):  # the others have a test of their own
            assert "CartesianProduct" not in plan(query(spark, sf)), name


def test_heavy_keys_run_through_the_tree(spark, sf):
    """Even the smallest table is cut into leaves, and their states merge in rounds."""
    from corpusloom.operators import hotkeys

    df = spark.read.parquet(f"{sf}/raw_clips.parquet").withColumn("k", hotkeys.F.md5("text_raw"))
    p = plan(hotkeys.tree_aggregate(df, {"k": hotkeys.F.col("k")}, [hotkeys.count_rows()], chunk=16))
    assert p.count("Exchange hashpartitioning(k") == 2 and "monotonically_increasing_id" in p
