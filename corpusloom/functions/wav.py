"""WAV headers and samples from binary columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _le(data: Column, at: int) -> Column:
    """Little-endian unsigned number of four bytes at the 1-based position."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i, 1)), 16, 10).cast("bigint")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def is_plain(data: Column) -> Column:
    """The common layout: RIFF, WAVE, fmt of 16 bytes, data right after it."""
    at = lambda i: F.hex(F.substring(data, i, 4))
    return F.coalesce((F.length(data) >= 44) & (at(1) == "52494646") & (at(9) == "57415645") & (at(13) == "666D7420") & (at(37) == "64617461"), F.lit(False))


def plain_duration(data: Column) -> Column:
    """Seconds by the header of the common layout, null for anything else. No sample is read."""
    return F.when(is_plain(data) & (_le(data, 29) > 0), _le(data, 41) / _le(data, 29))


def is_corrupt(data: Column) -> Column:
    """No bytes at all."""
    return data.isNull() | (F.length(data) == 0)


def header_seconds(data: bytes | None) -> float | None:
    """Seconds by the chunks of a WAV of any encoding, as declared; None where there is no format with channels and a
    rate before the samples. What is held of the samples is not asked."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, speed = 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            channels, rate, a_second = struct.unpack("<HII", data[at + 10 : at + 20])
            speed = a_second if channels and rate else 0
        elif name == b"data":
            return size / speed if speed else None
        at += 8 + size + (size & 1)
    return None


def plain_seconds(data: Column) -> Column:
    """:func:`header_seconds` for the common layout, null for anything else. No sample is read."""
    good = is_plain(data) & (F.hex(F.substring(data, 23, 2)) != "0000") & (_le(data, 25) > 0) & (_le(data, 29) > 0)
    return F.when(good, _le(data, 41) / _le(data, 29))


def with_seconds(df: DataFrame, data: str, made: str, *columns: str | Column) -> DataFrame:
    """``columns`` of ``df`` plus ``made``: seconds by the header of the binary column ``data``, null where it is
    corrupt (no bytes, or no header that can be read). Only bytes that have not the common layout leave the scan."""
    b = F.col(data)
    seconds = plain_seconds(b)
    rest = F.when(seconds.isNull() & ~is_corrupt(b), b).alias("__rest")
    source = df.select(*columns, seconds.cast("double").alias(made), rest)
    names = source.columns[:-1]
    schema = StructType(source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = x.column(made)
            if x.column("__rest").null_count < x.num_rows:
                own = pa.array([header_seconds(r.as_py()) if r.is_valid else s.as_py() for s, r in zip(own, x.column("__rest"), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names[:-1]), own], names)

    return source.mapInArrow(run, schema)


def parse(data: bytes | None) -> tuple[int, int, int, int, bytes] | None:
    """(rate, channels, bits, bytes declared, bytes held) by walking the chunks; None if it is no PCM WAV."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (rate, channels, bits) if kind in (1, 0xFFFE) else None
        elif name == b"data":
            return (*form, size, body) if form and form[0] and form[1] and form[2] in (8, 16, 24, 32) else None
        at += 8 + size + (size & 1)
    return None


def samples(held: bytes, channels: int, bits: int) -> np.ndarray:
    """Frames x channels, -1 to 1; a cut-off last frame is dropped."""
    width = bits // 8
    held = held[: len(held) // (width * channels) * width * channels]
    if bits == 8:
        x = (np.frombuffer(held, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 16:
        x = np.frombuffer(held, "<i2").astype(np.float32) / 32768
    elif bits == 32:
        x = np.frombuffer(held, "<i4").astype(np.float32) / 2147483648
    else:
        b = np.frombuffer(held, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x.astype(np.float32) / 8388608
    return x.reshape(-1, channels)


SIGNAL = "rate int, channels int, bits int, seconds double, frames bigint, peak double, rms double"


def with_signal(df: DataFrame, data: str, keep: list[str]) -> DataFrame:
    """``keep`` plus header and signal figures of the binary column ``data``; null figures where it cannot be decoded.
    The bytes do not leave the scan; a batch is decoded row by row, so memory is bounded by the longest clip."""
    source = df.select(*keep, F.col(data).alias("__data"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields) + ", " + SIGNAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for d in b.column("__data"):
                p = parse(d.as_py())
                if p is None:
                    row = (None,) * 7
                else:
                    rate, channels, bits, size, held = p
                    x = samples(held, channels, bits)
                    y = x.astype(np.float64)
                    row = (rate, channels, bits, size / (rate * channels * bits // 8), len(x), float(np.abs(y).max()) if y.size else 0.0, float(np.sqrt((y * y).mean())) if y.size else 0.0)
                for k, v in enumerate(row):
                    out[k].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], [*keep, "rate", "channels", "bits", "seconds", "frames", "peak", "rms"])

    return source.mapInArrow(run, schema)
