"""WAV files as columns: decoding, encoding and simple signal processing."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PCM_TYPE = "struct<samples: array<float>, sample_rate: int, channels: int>"


def parse_wav(content: bytes | None) -> tuple[np.ndarray, int, int] | None:
    """Samples in [-1, 1], rate and channels of a RIFF file; None for anything else, or another coding than PCM or IEEE float."""
    if not content or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE and len(body) >= 26:  # extensible: the coding comes later
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        return None
    coding, channels, rate, _, _, bits = form
    width = bits // 8
    raw = data[: len(data) // width * width] if width else b""
    if coding == 1 and bits == 8:
        out = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif coding == 1 and bits == 16:
        out = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif coding == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        out = (np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)).astype(np.float32)
    elif coding == 1 and bits == 32:
        out = (np.frombuffer(raw, "<i4") / float(1 << 31)).astype(np.float32)
    elif coding == 3 and bits in (32, 64):
        out = np.frombuffer(raw, f"<f{width}").astype(np.float32)
    else:
        return None
    return out, rate, channels


def format_wav(samples: np.ndarray, rate: int, channels: int) -> bytes:
    """A file of 16-bit PCM; samples are cut off at -1 and 1 and rounded toward zero."""
    body = (np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
    return head + body


def decode_wav(content: str) -> Column:
    """(samples, sample_rate, channels) of a column of files; null fields for those that can't be decoded."""

    def decode(contents: pd.Series) -> pd.DataFrame:
        found = [parse_wav(None if c is None else bytes(c)) for c in contents]
        return pd.DataFrame({"samples": [f and f[0] for f in found], "sample_rate": pd.array([f and f[1] for f in found], "Int32"), "channels": pd.array([f and f[2] for f in found], "Int32")})

    return F.pandas_udf(decode, PCM_TYPE)(content)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples, sample_rate, channels) of the .wav files below path; null samples for files that can't be decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", decode_wav("content").alias("x")).select("path", "x.samples", "x.sample_rate", "x.channels")


def encode_wav(samples: str, rate: str, channels: str) -> Column:
    """16-bit PCM files, as binary, of columns of samples; null where any is null."""

    def encode(s: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(y) or pd.isna(z) else format_wav(x, int(y), int(z)) for x, y, z in zip(s, r, c)], dtype=object)

    return F.pandas_udf(encode, "binary")(samples, rate, channels)


def to_mono(samples: str, channels: str) -> Column:
    """The mean of each frame; a part of a frame at the end is dropped."""
    n = F.floor(F.size(samples) / F.col(channels)).cast("int")
    frames = F.sequence(F.lit(0), n - 1)
    mean = lambda i: F.aggregate(F.slice(samples, i * F.col(channels) + 1, F.col(channels)), F.lit(0.0), lambda a, v: a + v) / F.col(channels)
    return F.when(n > 0, F.transform(frames, mean)).when(F.size(samples) >= 0, F.array().cast("array<double>"))


def peak(samples: str) -> Column:
    """The largest absolute value, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(samples, lambda v: F.abs(v))), F.lit(0.0).cast("float"))


def rms(samples: str) -> Column:
    """The root of the mean square in double precision, 0 if there is none."""
    squares = F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples))).otherwise(F.lit(0.0))


def duration_ms(samples: str, rate: str, channels: str) -> Column:
    """Whole milliseconds; 0 without a rate or channels."""
    usable = (F.col(rate) > 0) & (F.col(channels) > 0) & (F.size(samples) > 0)
    frames = F.floor(F.size(samples) / F.when(F.col(channels) > 0, F.col(channels)))
    return F.when(usable, F.floor(frames * 1000 / F.when(F.col(rate) > 0, F.col(rate)))).otherwise(F.lit(0)).cast("long")


def resampled(samples: str, old: str | Column, new: str | Column) -> Column:
    """Linear interpolation to round(n * new / old) samples, which keep the last value beyond the end; the samples if the rate stays."""
    x, a, b = F.col(samples), *(F.col(r) if isinstance(r, str) else r for r in (old, new))
    step = a.cast("double") / b.cast("double")
    n = F.floor(F.size(x) * (b.cast("double") / a.cast("double")) + 0.5).cast("int")

    def at(i: Column) -> Column:
        first = F.floor(i * step).cast("int")
        low, high = (F.get(x, first + k).cast("double") for k in (0, 1))
        return F.when(first + 1 < F.size(x), low + (high - low) * (i * step - first)).otherwise(F.element_at(x, -1).cast("double"))

    return F.when((a == b) | (F.size(x) == 0), F.transform(x, lambda v: v.cast("double"))).when((a > 0) & (b > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), at))


def sliced_ms(samples: str, rate: str, channels: str, start: Column, end: Column) -> Column:
    """The samples between two times in ms, whole frames, cut off at the end."""
    place = lambda t: (F.floor(t * F.col(rate) / 1000) * F.col(channels)).cast("int")
    return F.slice(samples, place(start) + 1, F.greatest(F.least(place(end), F.size(samples)) - place(start), F.lit(0)))


def plan_cuts(samples: np.ndarray, rate: int, target_ms: int, window_ms: int = 50) -> list[tuple[int, int]]:
    """(start, end) in ms of chunks of about target_ms that cover a mono recording, cut in the quietest window near each ideal end."""
    total = len(samples) * 1000 // rate if rate > 0 else 0
    window = max(rate * window_ms // 1000, 1)
    energy = np.concatenate([[0.0], np.cumsum(np.asarray(samples, np.float64) ** 2)])
    out, at = [], 0
    while at < total:
        ideal = min(at + target_ms, total)
        if ideal == total:
            out.append((at, total))
            break
        reach = max(target_ms // 5, 500)
        times = np.arange(max(ideal - reach, at + 1), min(ideal + reach, total) - window_ms + 1, window_ms)
        first = np.minimum(times * rate // 1000, len(samples))
        behind = np.minimum(first + window, len(samples))
        usable = behind > first
        cut = ideal
        if usable.any():
            mean = (energy[behind[usable]] - energy[first[usable]]) / (behind - first)[usable]
            cut = int(times[usable][int(mean.argmin())]) + window_ms // 2
        out.append((at, cut))
        at = cut
    return out


def cuts_of(mono: Column, rate: str, target_ms: int, window_ms: int = 50) -> Column:
    """plan_cuts as a column of (start_ms, end_ms)."""

    def run(samples: pd.Series, rates: pd.Series) -> pd.Series:
        found = [[] if x is None else plan_cuts(np.asarray(x, np.float64), int(r), target_ms, window_ms) for x, r in zip(samples, rates)]
        return pd.Series([[{"start_ms": a, "end_ms": b} for a, b in cuts] for cuts in found], dtype=object)

    return F.pandas_udf(run, "array<struct<start_ms: long, end_ms: long>>")(mono, F.col(rate))
