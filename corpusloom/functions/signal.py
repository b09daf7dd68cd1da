"""Signal functions on array columns of samples (-1 to 1). Null arrays give null; an empty array is silent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENT_PEAK, SILENT_RMS, CLIPPED_PEAK = 0.001, 0.0001, 0.99
TOP_DB, MARGIN_MS, MIN_SECONDS, FRAME_SECONDS = 40.0, 100.0, 1.0, 0.02
NORMAL_DB, QUIET = -3.0, 1e-8


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))), F.when(F.size(x) == 0, 0.0))


def rms(x: Column) -> Column:
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(x) == 0, 0.0).otherwise(F.sqrt(squares / F.size(x)))


def is_silent(peak_: Column, rms_: Column, peak_below: float = SILENT_PEAK, rms_below: float = SILENT_RMS) -> Column:
    """Undecodable audio (null) counts as silent."""
    return F.coalesce((peak_ < peak_below) | (rms_ < rms_below), F.lit(True))


def is_clipped(peak_: Column, at_least: float = CLIPPED_PEAK) -> Column:
    return F.coalesce(peak_ >= at_least, F.lit(False))


def mono(channels: Column) -> Column:
    """Mean over the inner arrays, one per frame: array<array<double>> -> array<double>."""
    return F.transform(channels, lambda frame: F.aggregate(frame, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(frame))


def peak_normalized(x: Column, db: float = NORMAL_DB) -> Column:
    """Scaled so that the peak is at ``db``; empty and (almost) silent signals as they are."""
    p = peak(x)
    return F.when(p > QUIET, F.transform(x, lambda v: v.cast("double") * F.lit(10.0 ** (db / 20.0)) / p)).otherwise(F.transform(x, lambda v: v.cast("double")))


def trimmed(x: Column, rate: int, top_db: float = TOP_DB, margin_ms: float = MARGIN_MS, min_seconds: float = MIN_SECONDS) -> Column:
    """Without the quiet stretches at both ends.

    A frame of 20 ms is voiced when its level is within ``top_db`` of the loudest frame's; a margin is kept on
    either side. Signals of fewer than two whole frames, and results shorter than ``min_seconds``, stay whole.
    """
    frame = max(1, int(rate * FRAME_SECONDS))
    margin = int(rate * margin_ms / 1000.0)
    frames = F.floor(F.size(x) / frame).cast("int")
    level = F.transform(
        F.sequence(F.lit(0), frames - 1), lambda i: F.sqrt(F.aggregate(F.slice(x, i * frame + 1, F.lit(frame)), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / frame + F.lit(1e-12))
    )
    voiced = lambda e: F.filter(F.transform(e, lambda v, i: F.when(v > F.array_max(e) * F.lit(10.0 ** (-top_db / 20.0)), i)), lambda i: i.isNotNull())
    bounds = F.transform(F.array(level), lambda e: F.struct(F.array_min(voiced(e)).alias("a"), F.array_max(voiced(e)).alias("b")))[0]
    first = F.greatest(F.lit(0), bounds["a"] * frame - margin)
    stop = F.least(F.size(x), (bounds["b"] + 1) * frame + margin)
    cut = stop - first
    return F.when((frames >= 2) & bounds["a"].isNotNull() & (cut >= rate * min_seconds), F.slice(x, first + 1, F.greatest(cut, F.lit(0)))).otherwise(x)


def resampled(x: Column, rate: Column, to: int = 16_000) -> Column:
    """Linear interpolation to ``to`` samples a second over the same span; empty signals stay empty."""
    n = F.size(x)
    m = F.bround(n / rate * to).cast("int")  # half to even
    step = F.when(m > 1, (n - 1).cast("double") / (m - 1)).otherwise(F.lit(0.0))

    def sample(i: Column) -> Column:
        at = i * step
        lo = F.least(F.floor(at).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        a, b = F.element_at(x, lo + 1).cast("double"), F.element_at(x, hi + 1).cast("double")
        return a + (b - a) * (at - lo)

    return F.when((n == 0) | (m < 1), F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), m - 1), sample))
