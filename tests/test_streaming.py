from pyspark.sql import functions as F

from corpusloom.streaming import clips


def test_first_copies(spark, tmp_path):
    rows = [(1, "a", 5.0, "2024-01-01"), (2, "a", 5.0, "2024-01-02"), (3, "b", 0.5, "2024-01-02"), (4, "b", 2.0, "2024-01-03"), (5, "c", None, "2024-01-03")]
    df = spark.createDataFrame(rows, "id long, k string, duration double, t string").withColumn("ingested_at", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = clips.clip_stream(spark, str(tmp_path / "in"), df.schema)
    out = clips.run_to_table(clips.first_copies(stream, ["k"]), "append")
    assert sorted(r.k for r in out.collect()) == ["a", "b"]
    counts = clips.run_to_table(clips.counts_by_window(stream), "complete")
    assert {str(r.start)[:10]: (r.n_rows, r.n_short) for r in counts.collect()} == {"2024-01-01": (1, 0), "2024-01-02": (2, 1), "2024-01-03": (2, 0)}
