from pyspark.sql import functions as F

from corpusloom.operators import dedup

ROWS = "id long, k string, text string, extra string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROWS)


def test_exact_dedup_keeps_the_first(spark):
    df = rows(spark, (3, "a", "x", "3"), (1, "a", "x", "1"), (2, "a", "y", "2"), (5, None, None, None), (4, None, None, "4"), (1, "a", "x", "1"))
    for n in (1, 2, 7):
        got = {tuple(r) for r in dedup.exact_dedup(df.repartition(n), ["k", "text"], "id").collect()}
        assert got == {(1, "a", "x", "1"), (2, "a", "y", "2"), (4, None, None, "4")}
    assert dedup.exact_dedup(df.limit(0), ["k"], "id").count() == 0


def test_cap(spark):
    long, short = "یک متن بلند با واژه های بسیار", "بله"
    data = [(i, "L", long, "") for i in range(6)] + [(i, "S", short, "") for i in range(10, 16)] + [(20, "F", short, ""), *[(20 + i, "F", long, "") for i in range(1, 5)]] + [(30, "B", long, ""), *[(30 + i, "B", short, "") for i in range(1, 5)]] + [(40 + i, None, long, "") for i in range(4)]
    for n in (1, 3):
        kept = sorted(r.id for r in dedup.capped(rows(spark, *data).repartition(n), "k", "text", "id").collect())
        assert kept == [0, 1, 2, *range(10, 16), *range(20, 25), 30, 31, 32, 40, 41, 42]
    e = dedup.excess_count(rows(spark, *data), "k", "text", "id").first()
    assert (e.n_groups, e.n_excess) == (3, 3 + 2 + 1)
    b = {r.kind: (r.n_rows, r.n_texts) for r in dedup.breakdown(rows(spark, *data), "k", "text", "id").collect()}
    assert b == {"short_kept": (11, 2), "long_within_cap": (0, 0), "long_over_cap_kept": (9, 3), "long_over_cap_dropped": (6, 3)}


def test_counts(spark):
    df = rows(spark, (1, "a", "x", ""), (2, "a", "x", ""), (3, "b", "x", ""))
    assert dedup.duplicate_count(df, "k", "text").first()[0] == 1
    assert [tuple(r) for r in dedup.frequencies(df, "k").collect()] == [("a", 2)]


def test_funnel_adds_up(spark, sf):
    from corpusloom.plans.cleaning import funnel

    r = funnel(spark, sf).first()
    assert r.n_raw == r.n_corrupt + r.n_short + r.n_long + r.n_exact_copies + r.n_excess + r.n_kept


def test_no_window_over_whole_groups(spark, sf):
    """The rank filter is limited per group before the shuffle."""
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("k"), F.lit("یک متن بلند با واژه").alias("text"))
    plan = dedup.capped(df, "k", "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_funnel_goes_by_the_header(spark, tmp_path):
    """Bytes that are no WAV are corrupt, whatever duration is stored; a WAV of another layout or encoding is not, and
    its own duration counts, not the stored one."""
    from corpusloom.plans import cleaning
    from tests.test_operators import make_wav

    def clip(i, data, stored=2.0):
        return (i, (data, f"{i}.wav"), f"یک متن بلند با واژه های بسیار {'ا' * i}", stored)

    plain = make_wav(frames=24_000)
    extra = make_wav(frames=24_000, chunk=b"LIST" + (3).to_bytes(4, "little") + b"abc\0")
    floats = plain[:20] + b"\x03\0" + plain[22:]
    mute = plain[:22] + b"\0\0" + plain[24:]
    bad = [b"not audio at all", b"", None, b"RIFF\0\0\0\0WAVE", plain[:40], mute, extra[:30]]
    rows = [clip(i, d, s) for i, (d, s) in enumerate([(plain, None), (extra, 99.0), (floats, 0.1), (plain[:60], float("nan"))])]
    rows += [clip(i, d) for i, d in enumerate(bad, 4)] + [clip(20, make_wav(frames=800)), clip(21, make_wav(rate=100, frames=3100))]
    spark.createDataFrame(rows, "id long, audio struct<bytes: binary, path: string>, text_raw string, duration double").write.parquet(f"{tmp_path}/raw_clips.parquet")
    found = {r.id: r.duration for r in cleaning.prepared(spark, str(tmp_path)).collect()}
    assert {i for i, s in found.items() if s is None} == set(range(4, 11)) and {found[i] for i in range(4)} == {1.5}
    r = cleaning.funnel(spark, str(tmp_path)).first()
    assert (r.n_raw, r.n_corrupt, r.n_short, r.n_long, r.n_kept) == (13, 7, 1, 1, 4)
    assert {r.id for r in cleaning.cleaned(spark, str(tmp_path)).collect()} == set(range(4))


def test_audio_keys(spark):
    """Empty bytes have a digest of their own; clips with neither bytes nor path share a key, null clips another."""
    import hashlib

    rows = [((b"x", "p"),), ((b"", "p"),), ((None, "p"),), ((None, ""),), ((None, None),), (None,)]
    from corpusloom.functions import text

    got = [r.k for r in spark.createDataFrame(rows, "audio struct<bytes: binary, path: string>").select(text.audio_key("audio").alias("k")).collect()]
    assert got == [hashlib.md5(b"x").hexdigest(), hashlib.md5(b"").hexdigest(), "p", "{}", "{}", "None"]
