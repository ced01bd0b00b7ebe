"""Texts as media: WAV files, short-time Fourier transforms and spectral fingerprints.

The bytes of a text, filled with spaces to a positive multiple of UNIT, are the
8-bit samples of a mono WAV file, written and read again by the wave module.
Frames of FRAME samples, HOP apart, are transformed; in each of BANDS bands of a
frame the strongest bin is a peak if no neighbouring frame has a stronger one in
that band. Each peak is paired with the next FAN peaks of at most REACH frames
later: a pair's code is (bin, bin, frames between), its time the first's frame.

Cases: a null text is empty, and an empty one is UNIT spaces. Equal texts give
equal media and fingerprints. A text that gives no pair has empty arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 8000
FRAME, HOP = 384, 192
BANDS = ((2, 12), (12, 36), (36, 84), (84, 193))
FAN, REACH = 3, 8

SCHEMA = "struct<n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, times: array<int>, codes: array<bigint>>"


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the peak pairs, in order of time."""
    data = np.frombuffer(samples, np.uint8)
    if len(data) < FRAME:
        data = np.r_[data, np.full(FRAME - len(data), 128, np.uint8)]
    frames = np.lib.stride_tricks.sliding_window_view(data, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    peaks, strengths = [], []
    for a in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft((frames[a : a + 2048].astype(np.float32) - 128) * window))
        peaks.append(np.stack([low + power[:, low:high].argmax(1) for low, high in BANDS], 1))
        strengths.append(np.stack([power[:, low:high].max(1) for low, high in BANDS], 1))
    bins, strength = np.concatenate(peaks), np.concatenate(strengths)
    top = strength > 1e-3
    top[1:] &= strength[1:] >= strength[:-1]
    top[:-1] &= strength[:-1] >= strength[1:]
    time, band = np.nonzero(top)
    at = bins[time, band]
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = time[k:] - time[:-k]
        near = gap <= REACH
        times.append(time[:-k][near])
        codes.append((at[:-k][near].astype(np.int64) << 16) | (at[k:][near] << 4) | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order]


def _media(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        raw = (text.as_py() or "").encode()
        media = to_wav(payload(raw))
        back = from_wav(media)
        times, codes = fingerprint(back)
        rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), times, codes))
    columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
    lists = []
    for values, kind in ((columns[6], pa.int32()), (columns[7], pa.int64())):
        ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if len(values) else np.zeros(0), kind)))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    return pa.StructArray.from_arrays([*arrays, *lists], ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"])


def media_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the fields of SCHEMA, computed from what is read back; columns of their names are replaced."""
    column = F.arrow_udf(_media, SCHEMA)(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    fields = [f.split(":")[0] for f in SCHEMA.removeprefix("struct<").removesuffix(">").split(", ")]
    rows = docs.select(F.struct("*").alias("doc"), column.alias("media"))
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in fields], *[F.col(f"media.{f}") for f in fields])


def media_files(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """docs with the WAV file of each text, binary."""
    files = F.arrow_udf(lambda texts: pa.array([to_wav(payload((t.as_py() or "").encode())) for t in texts], pa.binary()), "binary")
    rows = docs.select(F.struct("*").alias("doc"), files(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("file"))
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != to.lower()], F.col("file").alias(to))
