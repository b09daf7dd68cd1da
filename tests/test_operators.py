import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import audio, signal, wav
from corpusloom.operators import batching, guards, joins, metrics, split
from corpusloom.sources import shards, sinks


def arr(spark, x, column, kind="array<double>"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_ranges(spark):
    df = spark.createDataFrame([(None,), (0.999,), (1.0,), (30.0,), (30.001,), (float("nan"),)], "d double")
    assert [r.d for r in df.filter(metrics.in_range(F.col("d"))).collect()] == [1.0, 30.0]
    assert tuple(metrics.outliers(df, "d").first()) == (6, 2, 1, 1, 30.001)


def test_rates(spark):
    df = spark.createDataFrame([("a b c d e", 1.0), ("abcdefgh", 1.0), ("a", None), ("", 1.0), ("a", 0.0)], "t string, d double")
    got = metrics.with_rates(df, "t", "d")
    assert [(r.wps, r.cps) for r in got.collect()] == [(5.0, 9.0), (1.0, 8.0), (None, None), (0.0, 0.0), (None, None)]
    r = metrics.rate_outliers(got).first()
    assert (r.n_fast, r.n_slow, r.n_either) == (0, 1, 1)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)] + [(None,)], "v double")
    assert {r.bin: r.n for r in metrics.histogram(df, "v", 5).collect()} == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}
    assert sum(r.n for r in metrics.histogram(df.limit(0), "v", 5).collect()) == 0
    assert metrics.histogram(df.filter("v = 1"), "v", 2).agg(F.sum("n")).first()[0] == 1


@pytest.mark.parametrize(("ref", "hyp", "w", "c"), [("یک دو سه", "یک دو سه", 0, 0), ("یک دو سه", "یک چهار سه", 1, 4), ("یک دو", "یک دو سه", 1, 3), ("یک دو سه", "یک سه", 1, 3), ("كتاب", "کتاب", 0, 0), ("یک", None, 1, 2)])
def test_error_rates(spark, ref, hyp, w, c):
    r = metrics.error_rates(spark.createDataFrame([(ref, hyp)], "r string, p string"), "r", "p").first()
    assert (r.word_edits, r.char_edits) == (w, c)


def test_error_rates_without_references(spark):
    r = metrics.error_rates(spark.createDataFrame([("", "a"), ("!", "b"), (None, None)], "r string, p string"), "r", "p").first()
    assert (r.n_dropped, r.wer, r.cer) == (3, 0.0, 0.0)


def test_gate(spark):
    df = spark.range(1000).select("id", (F.col("id") < 5).alias("bad"))
    assert metrics.drop_failed(df, F.col("bad")).count() == 995  # exactly the limit
    with pytest.raises(joins.DataError):
        metrics.drop_failed(df.withColumn("bad", F.col("id") < 6), F.col("bad"))


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(2, "x"), (9, "y")], "id long, cleaned_text string")
    assert [tuple(r) for r in joins.attach(a, b).collect()] == [(2, "x")]
    assert {(r.id, r.split) for r in joins.routed(a, {"train": b, "val": a.filter("id < 3")}).collect()} == {(1, "val"), (2, "train"), (3, "unused")}
    with pytest.raises(joins.DataError, match="1 of 2"):
        joins.check_coverage(b, a)
    assert joins.check_coverage(b, a, partial=True) == 1
    with pytest.raises(joins.DataError, match="no label"):
        joins.check_coverage(b.filter("id = 9"), a)
    with pytest.raises(joins.DataError, match="both splits"):
        joins.check_no_leakage(a, b)
    with pytest.raises(joins.DataError, match="repeated"):
        joins.require_unique(b.unionByName(b))
    with pytest.raises(joins.DataError, match="missing columns: cleaned_text"):
        joins.attach(a, a)
    with pytest.raises(joins.DataError):
        joins.check_not_empty(train=a, val=a.limit(0))


@pytest.mark.parametrize("few", [5, 50_000])
def test_split_is_exact(spark, few, monkeypatch):
    monkeypatch.setattr(split, "FEW", few)
    df = spark.range(1001)
    cut = split.cut_at(df, "id", 151, few=few)
    want = sorted((__import__("hashlib").md5(f"42:{i}".encode()).hexdigest(), i) for i in range(1001))[150]
    assert cut == want
    out = split.train_val(df.repartition(7), "id")
    assert out.filter("split = 'val'").count() == math.ceil(0.15 * 1001)
    assert split.subset(df, "id", 0).count() == 0 and split.subset(df, "id", 5000).count() == 1001 and split.subset(df.limit(0), "id", 3).count() == 0


def test_batching(spark):
    df = spark.createDataFrame([(1, 0, [7, 1]), (2, 0, [7, 2, 3]), (3, 1, [7]), (4, 1, [8, 9]), (5, 2, [])], "id int, b int, l array<int>")
    assert {r.id: r.l for r in batching.padded(df, "l", "b").collect()} == {1: [7, 1, -100], 2: [7, 2, 3], 3: [7, -100], 4: [8, 9], 5: []}
    assert {r.id: r.l for r in batching.without_start(df, "l", "b", 7).collect()} == {1: [1], 2: [2, 3], 3: [7], 4: [8, 9], 5: []}
    assert arr(spark, [-100, 5], lambda x: batching.unmasked(x, 0), "array<int>") == [0, 5]
    assert len(arr(spark, list(range(500)), batching.truncated, "array<int>")) == 448


def test_quality_gate(spark):
    t = spark.createDataFrame([(1, "خوب"), (1, "كتاب"), (2, " ")], "id long, t string")
    v = spark.createDataFrame([(2, "۱۲"), (3, None)], "id long, t string")
    got = {r.check: r.n_bad for r in guards.quality_gate(t, v, "id", "t").collect()}
    want = {"missing_train": 0, "missing_val": 0, "empty_train": 0, "empty_val": 0, "train_rows_off": 0, "val_rows_off": 0, "repeated_train_ids": 1, "repeated_val_ids": 0, "overlapping_ids": 1, "arabic_letters": 1, "digits": 1, "blank_labels": 2}
    assert got == want
    off = {r.check: r.n_bad for r in guards.quality_gate(t, v, "id", "t", (5, 1)).collect()}
    assert off == want | {"train_rows_off": 2, "val_rows_off": 1}
    alone = {r.check: r.n_bad for r in guards.quality_gate(None, v, "id", "t").collect()}
    assert alone["missing_train"] == alone["empty_train"] == 1 and alone["overlapping_ids"] == 0
    assert guards.table_if_present(spark, "/nowhere/x.parquet") is None


def test_joins_refuse_repeated_labels(spark):
    a, b = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "z")], "id long, cleaned_text string")
    with pytest.raises(joins.DataError, match="repeated"):
        joins.attach(a, b)
    assert joins.attach(a, b, unique=False).count() == 2
    assert joins.sanitized(b, ("cleaned_text",)).columns == ["cleaned_text"]
    with pytest.raises(joins.DataError, match="missing"):
        joins.sanitized(b, ("other",))


def test_median_is_exact(spark):
    import statistics

    r = np.random.default_rng(2)
    for x in ([], [3.0], [1.0, 2.0], [5.0] * 7, r.exponential(3, 501).tolist(), [1e-300, 1e300, 2.0, 2.0], r.integers(0, 3, 300).astype(float).tolist()):
        df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double")
        assert metrics.median(df, "v") == (statistics.median(x) if x else None)
        for rank in {1, len(x) // 2, len(x)} - {0}:
            assert not x or metrics.value_at(df, "v", rank, few=2, bins=4) == sorted(x)[rank - 1]
    assert metrics.value_at(df, "v", 10**6) is None


def test_runs(spark):
    df = spark.createDataFrame([("base", 110.0, 10.0), ("half", 60.0, 10.0), ("no eval", 50.0, None), ("none", None, None)], "name string, train_runtime double, eval_runtime double")
    out = {r.name: r for r in metrics.against_baseline(metrics.run_times(df, 10, 5), "base", 3600, 4.0).collect()}
    assert (out["base"].s_per_step, out["half"].speedup, out["half"].hours, out["half"].reference_hours) == (10.0, 2.0, 5.0, 2.0)
    assert out["no eval"].s_per_step is None and out["no eval"].hours is None and out["none"].speedup is None
    assert {r.name for r in metrics.chosen(df, " base ,half").collect()} == {"base", "half"}
    with pytest.raises(joins.DataError, match="unknown names: other"):
        metrics.chosen(df, "base, other")
    assert metrics.storage(df, 10**9, 1, 5.0).first().fits and metrics.storage(df, 10**9, 1, 4.5).first().fits is False and metrics.storage(df).first().fits is None


def test_split_without_keys(spark):
    df = spark.createDataFrame([(i,) for i in range(20)] + [(None,)] * 3, "id long")
    out = split.train_val(df, "id")
    assert out.filter("split = 'val'").count() == 3 and out.filter("id IS NULL AND split = 'train'").count() == 3
    assert split.subset(df, "id", 50).count() == 20 and split.subset(df, "id", 5).count() == 5
    same = spark.createDataFrame([(7,)] * 40, "id long")
    assert split.cut_at(same, "id", 30, few=5)[1] == 7 and split.cut_at(same, "id", 41, few=5) is None


# --- signals ---


def test_levels(spark):
    assert arr(spark, [], signal.peak) == 0.0 and arr(spark, [], signal.rms) == 0.0 and arr(spark, None, signal.peak) is None
    assert arr(spark, [0.5, -0.99], lambda x: signal.is_clipped(signal.peak(x))) and not arr(spark, [0.989], lambda x: signal.is_clipped(signal.peak(x)))
    assert arr(spark, [0.0] * 9, lambda x: signal.is_silent(signal.peak(x), signal.rms(x))) and arr(spark, None, lambda x: signal.is_silent(signal.peak(x), signal.rms(x)))
    assert arr(spark, [0.25, -0.5], signal.peak_normalized) == pytest.approx([0.5 * 10 ** (-3 / 20), -(10 ** (-3 / 20))])
    assert arr(spark, [1e-8], signal.peak_normalized) == [1e-8] and arr(spark, [], signal.peak_normalized) == []
    assert arr(spark, [[1.0, 0.0], [0.5, 0.5]], signal.mono, "array<array<double>>") == [0.5, 0.5]


@pytest.mark.parametrize("seed", range(6))
def test_trim_and_resample(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1e-4, 300 * seed), rng.normal(0, 0.3, 900), rng.normal(0, 1e-4, 100 * seed), np.zeros(seed)])
    got = arr(spark, x.tolist(), lambda c: signal.trimmed(c, 400, 40.0, 100.0, 1.0))
    assert np.allclose(got, audio.trim(x, 400))
    got = arr(spark, x.tolist(), lambda c: signal.resampled(c, F.lit(400), 1000))
    m = round(len(x) / 400 * 1000)
    assert np.allclose(got, np.interp(np.linspace(0, len(x) - 1, m), np.arange(len(x)), x))
    assert arr(spark, [], lambda c: signal.resampled(c, F.lit(400))) == []


def make_wav(rate=16000, channels=1, frames=800, width=2, chunk=b""):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((np.full((frames, channels), 16384, "<i2")).tobytes())
    data = f.getvalue()
    return data[:36] + chunk + data[36:] if chunk else data


def test_wav(spark):
    extra = b"LIST" + (3).to_bytes(4, "little") + b"abc\0"
    rows = [(1, make_wav(8000)), (2, make_wav(16000, 2)), (3, make_wav(44100)), (4, make_wav(chunk=extra)), (5, make_wav()[:60]), (6, b""), (7, b"not audio at all"), (8, None)]
    df = spark.createDataFrame(rows, "id int, b binary")
    head = {r.id: r.s for r in df.select("id", wav.plain_seconds(F.col("b")).alias("s")).collect()}
    assert head == {1: 0.1, 2: 0.05, 3: pytest.approx(800 / 44100), 4: None, 5: 0.05, 6: None, 7: None, 8: None}
    got = {r.id: r for r in wav.with_signal(df, "b", ["id"]).collect()}
    assert got[4].seconds == 0.05 and got[4].peak == 0.5 and got[2].channels == 2 and got[5].frames == 8 and got[5].seconds == 0.05
    assert got[7].peak is None and got[8].rms is None
    assert {r.id for r in df.filter(wav.is_corrupt(F.col("b"))).collect()} == {6, 8}


# --- sources and sinks ---


def test_shards(spark, tmp_path):
    rows = [(i, bytearray(b"x"), f"p{i}", None if i == 3 else f"t{i}", 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, b binary, p string, text string, duration double").select("id", F.struct(F.col("b").alias("bytes"), F.col("p").alias("path")).alias("audio"), "text", "duration")
    for k in (0, 1):
        part = tmp_path / f"part{k}"
        df.filter(F.col("id") % 2 == k).coalesce(1).write.parquet(str(part))
        (tmp_path / "deep/data").mkdir(parents=True, exist_ok=True)
        next(part.glob("*.parquet")).rename(tmp_path / f"deep/data/train-{k}.parquet")
    (tmp_path / "deep/investigation_results").mkdir()
    got = shards.read_shards(spark, str(tmp_path / "deep"), ("id", "text", "duration")).orderBy("row_order").collect()
    assert [r.id for r in got] == [0, 2, 4, 1, 3, 5] and got[4].text_raw == "" and "audio" not in got[0]
    assert shards.read_shards(spark, str(tmp_path), first=1).count() == 3
    with pytest.raises(joins.DataError):
        shards.shard_files(spark, str(tmp_path / "part0"))
    with pytest.raises(joins.DataError):
        shards.shard_files(spark, str(tmp_path / "nowhere"))


def test_shards_at_all_depths(spark, tmp_path):
    """None directly, none in data: every depth counts, but not the excluded folder."""
    places = ["a", "b/c", "b/c/d", "e/f/g/h/i/j/k/l", "a/investigation_results", "investigation_results/x"]
    for k, place in enumerate(places):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / f"train-{k}.parquet").write_bytes(b"")
        (tmp_path / place / f"test-{k}.parquet").write_bytes(b"")
    found = [f.removeprefix(f"file:{tmp_path}/") for f in shards.shard_files(spark, str(tmp_path))]
    assert found == sorted(f"{p}/train-{k}.parquet" for k, p in enumerate(places[:4]))
    (tmp_path / "data").mkdir()
    (tmp_path / "data/train-9.parquet").write_bytes(b"")
    assert len(shards.shard_files(spark, str(tmp_path))) == 1


def test_csv(spark, tmp_path):
    rows = [(1, 1.0, 'a "q", b', " x "), (2, None, "line\nbreak", "NA"), (3, 2.0, None, "")]
    df = spark.createDataFrame(rows, "id long, duration double, text_raw string, cleaned_text string")
    sinks.write_csv(df, str(tmp_path / "c"), backup="nowhere://x/y")
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbfid,") for f in (tmp_path / "c").glob("*.csv"))
    back = {r.id: r for r in shards.read_labels(spark, str(tmp_path / "c")).collect()}
    assert back[1].text_raw == 'a "q", b' and back[1].cleaned_text == " x " and back[2].text_raw == "line\nbreak" and back[2].cleaned_text == "NA" and back[3].text_raw is None
    (tmp_path / "bom.csv").write_text("﻿id,cleaned_text\n7,خوب\n", encoding="utf-8")
    assert [tuple(r) for r in shards.read_labels(spark, str(tmp_path / "bom.csv")).collect()] == [(7, "خوب")]
    (tmp_path / "bad.csv").write_text("id,other\n7,x\n")
    with pytest.raises(joins.DataError):
        shards.read_labels(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(Exception, match="blank label of id 3"):
        shards.usable_labels(df).collect()
    with pytest.raises(Exception, match="blank label of id 3"):
        shards.read_labels(spark, str(tmp_path / "c"), usable=True).collect()
    sinks.write_splits(spark.range(40).select("id", F.lit("x").alias("cleaned_text")), str(tmp_path / "s"), backup=str(tmp_path / "t"))
    assert [shards.read_labels(spark, f"{tmp_path}/{f}").count() for f in ("s/cleaned", "s/train", "s/val", "t/val")] == [40, 34, 6, 6]
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_symbols_of_many_words(spark):
    """Words far back in a pair's vocabulary keep symbols of their own."""
    at = [1, 35327, 35328, 35329, 36000, 45567, 45568, 45569, 60000]
    words = F.transform(F.sequence(F.lit(1), F.lit(60000)), lambda i: i.cast("string"))
    got = spark.range(1).select(metrics._symbols(F.array(*[F.lit(str(i)) for i in at]), words)).first()[0]
    assert len(got) == len(set(got)) == len(at)
