import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import audio, signal
from corpusloom.plans import signals
from test_operators import make_wav


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_columns(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.zeros(900), rng.normal(0, 0.2, 1500), np.zeros(700)]).astype(np.float64)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    t, n, r = df.select(signal.trimmed(F.col("x"), 1000, min_seconds=0.5), signal.peak_normalized(F.col("x")), signal.resampled(F.col("x"), F.lit(8000))).first()
    assert np.allclose(audio.trim(x, 1000, min_seconds=0.5), t) and len(t) < len(x)
    assert np.allclose(audio.level(x), n, atol=1e-6)
    assert np.allclose(audio.resample(x, 8000), r, atol=1e-6)


def test_log_mel_peaks_at_the_tone():
    t = np.arange(16000 * 2) / 16000
    for hz in (300, 1000, 4000):
        m = audio.log_mel(0.5 * np.sin(2 * np.pi * hz * t))
        assert m.shape == (128, 3000)
        band = int(m[:, 50].argmax())
        centre = audio._hz(np.linspace(audio._mel(0.0), audio._mel(8000.0), 130))[band + 1]
        assert abs(centre - hz) < 60 + hz * 0.03
        assert m.max() - m.min() <= 2.0 + 1e-6
    assert np.all(audio.log_mel(np.zeros(10)) == audio.log_mel(np.zeros(0)))


@pytest.mark.parametrize(
    ("loud", "rate", "want"),
    [  # (first and last loud sample), rate -> (first kept, one past the last kept), frames of 20 ms, margin 100 ms
        ((4000, 7999), 1000, (3900, 8100)), ((0, 1999), 1000, (0, 2100)), ((9000, 9999), 1000, (8900, 10_000)),
        ((5000, 5009), 1000, None), ((4995, 7005), 1000, (4880, 7120)), ((0, 9999), 1000, (0, 10_000)),
    ],
)
def test_trim_written_out(loud, rate, want):
    """Ten seconds at 1 kHz; a result under a second leaves the clip whole."""
    x = np.full(10_000, 1e-4)
    x[loud[0] : loud[1] + 1] = 0.5
    got = audio.trim(x + np.arange(10_000) * 1e-12, rate)
    begin, end = want or (0, 10_000)
    assert len(got) == end - begin and got[0] == x[begin] + begin * 1e-12
    assert len(audio.trim(np.ones(39), rate, min_seconds=0)) == 39 and len(audio.trim(np.zeros(5000), rate)) == 5000


def test_sources(tmp_path):
    """Array before bytes before path; a kind that is there but bad is not made up by the next."""
    good, path = make_wav(8000), tmp_path / "a.wav"
    path.write_bytes(good)
    assert audio.sourced([0.5, -0.5], None, b"bad", None)[0] == audio.RATE
    assert audio.sourced([[1.0, 0.0], [0.0, 0.0]], 8000, None, None)[1].tolist() == [0.5, 0.0]
    assert audio.sourced(None, None, good, None)[0] == 8000 and audio.sourced(None, None, b"bad", str(path)) is None
    assert audio.sourced(None, None, None, str(path))[0] == 8000 and audio.sourced(None, None, None, "nowhere") is None and audio.sourced([], 8000, None, None) is None


def _batch(arrays, kind):
    empty = {"__sampling_rate": pa.int32(), "__bytes": pa.binary(), "__path": pa.string()}
    return pa.RecordBatch.from_pydict({"__array": pa.array(arrays, kind), **{n: pa.nulls(len(arrays), k) for n, k in empty.items()}})


def test_arrays_are_read_without_an_object_per_sample():
    """Slices, other kinds of number, missing samples and rows, frames of channels give what the lists would."""
    for kind in (pa.float64(), pa.float32(), pa.int32()):
        lists = [[1, 2, 3], [], None, [None, 4], [5]]
        for got, want in zip(audio._each(_batch(lists, pa.list_(kind)).slice(1)), lists[1:], strict=True):
            assert got is None if not want else got[0] == audio.RATE and got[1].dtype == np.float64 and np.array_equal(got[1], np.asarray(want, np.float64), equal_nan=True)
    frames = list(audio._each(_batch([[[1.0, 0.0], [0.0, 0.0]], None], pa.list_(pa.list_(pa.float64())))))
    assert frames[0][1].tolist() == [0.5, 0.0] and frames[1] is None
    long = _batch([np.arange(200_000) / 200_000], pa.list_(pa.float64()))
    tracemalloc.start()
    try:
        x = next(audio._each(long))[1]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(x) == 200_000 and x[-1] == 199_999 / 200_000
    assert most < 3 * x.nbytes  # floats and their list take four times the samples


def test_stretch_sample_by_sample(spark):
    n = signals.LENGTH
    rows = [(0, 0), (0, n), (1, 2), (7, 4008), (8, 4009), (-3, 5), (-9, -2), (n - 1, n + 5), (n, n + 1), (n + 7, n + 9), (50, 20), (None, 9), (3, None)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for r in df.select("a", "b", signals._stretch(F.col("a"), F.col("b")).alias("x")).collect():
        a, b = (n, n) if r.a is None or r.b is None else (r.a, r.b)
        assert r.x == [(signals.LOUD if i % 2 == 0 else -signals.LOUD / 2) if a <= i < b else signals.QUIET for i in range(n)]


def test_silent_frames_are_as_transformed():
    rng = np.random.default_rng(1)
    for n in (0, 8, 399, 400, 16_000 * 2 + 7, 16_000 * 30 - 100, 16_000 * 31):
        x = rng.normal(0, 0.1, n)
        full = audio.log_mel(np.concatenate([x, np.zeros(max(0, 16_000 * 30 - n))]))
        assert np.allclose(audio.log_mel(x), full)


def test_features(spark):
    rows = [(1, make_wav(8000, 2, 4000)), (2, b"no"), (3, None), (4, make_wav(frames=0))]
    df = spark.createDataFrame(rows, "id int, b binary")
    got = {r.id: r for r in audio.with_features(df, "b", ["id"], mels=16, seconds=1).collect()}
    assert [got[i].decode_ok for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert len(got[1].input_features) == 16 and len(got[1].input_features[0]) == 100 and got[2].input_features is None
