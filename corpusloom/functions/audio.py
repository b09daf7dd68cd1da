"""Clips of real length in numpy, inside Arrow batches: decode, mix down, resample, trim, level, log-mel features.

The functions agree with the Column functions of :mod:`corpusloom.functions.signal`; those suit short arrays, these
whole recordings. A clip that cannot be decoded gives a row with ``decode_ok`` false and no features.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.functions import signal as S
from corpusloom.functions.wav import parse, samples

RATE, SECONDS, MELS, WINDOW, HOP = 16_000, 30, 128, 400, 160


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    n = round(len(x) / rate * to)
    if rate == to or not len(x) or not n:
        return x
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


def trim(x: np.ndarray, rate: int, top_db: float = S.TOP_DB, margin_ms: float = S.MARGIN_MS, min_seconds: float = S.MIN_SECONDS) -> np.ndarray:
    """Without the quiet ends; see :func:`corpusloom.functions.signal.trimmed`.

    Powers of whole frames are differences of the running sum of squares; compared are powers, not levels."""
    frame = max(1, int(rate * S.FRAME_SECONDS))
    bounds = np.arange(0, len(x) + 1, frame)
    if len(bounds) < 3:
        return x
    energy = np.concatenate([[0.0], np.cumsum(np.asarray(x, np.float64) ** 2)])
    power = np.maximum(np.diff(energy[bounds]), 0.0) / frame + 1e-12
    voiced = power > power.max() * 10.0 ** (-top_db / 10.0)
    margin = int(rate * margin_ms / 1000.0)
    begin = bounds[voiced.argmax()] - margin if voiced.any() else 0
    end = bounds[len(voiced) - voiced[::-1].argmax()] + margin if voiced.any() else len(x)
    begin, end = max(begin, 0), min(end, len(x))
    return x[begin:end] if end - begin >= rate * min_seconds else x


def level(x: np.ndarray, db: float = S.NORMAL_DB) -> np.ndarray:
    top = float(np.abs(x).max()) if len(x) else 0.0
    return x * (10.0 ** (db / 20.0) / top) if top > S.QUIET else x


def _mel(hz: np.ndarray | float) -> np.ndarray:
    """Linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000.0, hz * 3 / 200.0, 15.0 + np.log(np.maximum(hz, 1e-9) / 1000.0) * 27.0 / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15.0, mel * 200.0 / 3, 1000.0 * np.exp((mel - 15.0) * np.log(6.4) / 27.0))


@lru_cache(maxsize=4)
def filters(rate: int = RATE, mels: int = MELS, window: int = WINDOW) -> np.ndarray:
    """Triangular filters of equal area, mels x frequencies."""
    f = np.linspace(0, rate / 2, window // 2 + 1)
    edge = _hz(np.linspace(_mel(0.0), _mel(rate / 2), mels + 2))
    up = (f[None] - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - f[None]) / np.diff(edge)[1:, None]
    return (np.maximum(0, np.minimum(up, down)) * (2.0 / (edge[2:] - edge[:-2]))[:, None]).astype(np.float32)


def log_mel(x: np.ndarray, rate: int = RATE, seconds: int = SECONDS, mels: int = MELS) -> np.ndarray:
    """Log-mel features, mels x frames, of a clip padded or cut to ``seconds``: decimal logarithm, at most 8 below the
    largest, shifted and scaled to about -1 to 1."""
    n, rim = rate * seconds, WINDOW // 2
    x = np.asarray(x[:n], np.float64)
    # Frames that lie wholly in the padding are silent and need no transform.
    sounding = min(n // HOP, (len(x) + rim) // HOP + 1)
    size = sounding * HOP + WINDOW
    if n > size + WINDOW:  # the end of the padding is out of sight
        x = np.pad(np.pad(x, (0, size - len(x))), (rim, 0), mode="reflect")
    else:
        x = np.pad(np.pad(x, (0, n - len(x))), rim, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:sounding]
    power = np.abs(np.fft.rfft(frames * np.hanning(WINDOW + 1)[:-1], axis=1)) ** 2
    heard = np.log10(np.maximum(filters(rate, mels) @ power.T, 1e-10))
    least = max(heard.max(initial=-10.0), -10.0) - 8.0
    out = np.full((mels, n // HOP), (max(least, -10.0) + 4.0) / 4.0, np.float32)
    out[:, :sounding] = (np.maximum(heard, least) + 4.0) / 4.0
    return out


def decoded(data: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, mixed-down samples) of the bytes; None when they cannot be decoded or hold no frame."""
    p = parse(data)
    if p is None:
        return None
    rate, channels, bits, _, held = p
    x = samples(held, channels, bits).mean(1, dtype=np.float64)
    return (rate, x) if len(x) else None


def sourced(array: list | np.ndarray | None, rate: int | None, data: bytes | None, path: str | None) -> tuple[int, np.ndarray] | None:
    """(rate, samples) from the first kind of source that is there: an array (of frames, or of channels per frame) with
    its rate, else bytes, else a file; a kind that is there but cannot be decoded is not made up by the next. A path
    must be readable on the executors."""
    if array is not None:
        x = np.asarray(array, np.float64)
        return (rate or RATE, x.mean(1) if x.ndim > 1 else x) if x.size else None
    if data is not None:
        return decoded(data)
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            return decoded(f.read())
    return None


def prepared(found: tuple[int, np.ndarray] | None, trimmed: bool = True, levelled: bool = True) -> np.ndarray | None:
    """Resampled, then trimmed, then levelled; None for None."""
    if found is None:
        return None
    x = resample(found[1], found[0])
    x = trim(x, RATE) if trimmed else x
    return level(x) if levelled else x


def clip(data: bytes | None, trimmed: bool = True, levelled: bool = True) -> np.ndarray | None:
    """Decode, mix down, resample, then trim, then level; None when it cannot be decoded or holds no frame."""
    return prepared(decoded(data), trimmed, levelled)


#: Fields of a source struct, in the order in which they are tried.
SOURCE = ("array", "sampling_rate", "bytes", "path")


def _sources(df: DataFrame, audio: str, keep: list[str]) -> DataFrame:
    """``keep`` and one column per field of SOURCE, null where the column ``audio`` (a struct, or plain binary) has none."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType, StructType

    kind = df.select(F.col(audio).alias("a")).schema["a"].dataType
    empty = {"array": "array<double>", "sampling_rate": "int", "bytes": "binary", "path": "string"}
    if isinstance(kind, BinaryType):
        have = {"bytes": F.col(audio)}
    else:
        have = {n: F.col(audio)[n] for n in (kind.names if isinstance(kind, StructType) else ()) if n in SOURCE}
    return df.select(*keep, *[have.get(n, F.lit(None).cast(empty[n])).alias(f"__{n}") for n in SOURCE])


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields) + ", " + more


def _held(v: pa.Scalar) -> object:
    """The value; a list of numbers as an array, without a Python object for each, missing ones as NaN."""
    if v.is_valid and pa.types.is_list(v.type) and not pa.types.is_nested(v.type.value_type):
        return v.values.to_numpy(zero_copy_only=False)
    return v.as_py()


def _each(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray] | None]:
    for row in zip(*(b.column(f"__{n}") for n in SOURCE), strict=True):
        yield sourced(*map(_held, row))


def with_features(df: DataFrame, audio: str, keep: list[str], trimmed: bool = True, levelled: bool = True, mels: int = MELS, seconds: int = SECONDS, rows: int = 16, pooled: bool = False) -> DataFrame:
    """``keep`` plus input_features (array of ``mels`` arrays) and decode_ok. Batches of ``rows`` rows are flushed as they
    are made, which bounds the memory. ``pooled``: the mean of each band over time instead (array of ``mels`` numbers)."""
    kind = pa.list_(pa.float32()) if pooled else pa.list_(pa.list_(pa.float32()))
    schema = _schema(df, keep, f"input_features {'array<float>' if pooled else 'array<array<float>>'}, decode_ok boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                made = [prepared(x, trimmed, levelled) for x in _each(b)]
                features = [None if x is None else log_mel(x, seconds=seconds, mels=mels) for x in made]
                column = pa.array([None if f is None else f.mean(1, dtype=np.float64) if pooled else list(f) for f in features], kind)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), column, pa.array([x is not None for x in made])], [*keep, "input_features", "decode_ok"])

    return _sources(df, audio, keep).mapInArrow(run, schema)


def with_levels(df: DataFrame, audio: str, keep: list[str], trimmed: bool = True, levelled: bool = True) -> DataFrame:
    """``keep`` plus figures of the prepared clip: n_in and n_out samples, peak and total; null where it cannot be decoded."""
    schema = _schema(df, keep, "n_in bigint, n_out bigint, peak double, total double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for found in _each(b):
                x = prepared(found, trimmed, levelled)
                out.append((None,) * 4 if x is None else (len(found[1]), len(x), float(np.abs(x).max()), float(x.sum())))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, "n_in", "n_out", "peak", "total"])

    return _sources(df, audio, keep).mapInArrow(run, schema)
