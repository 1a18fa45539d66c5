"""Audio columns: WAV files, short-time Fourier transforms and spectral-peak fingerprints.

A payload is stored as an 8-bit mono WAV file in a binary column of a Parquet table (``store``). Features
are computed from the samples that the ``wave`` module reads back from that column (``features``): the
power spectrum of windowed frames; per
frame and frequency band the strongest bin, where it is a peak in time; and pairs of a peak with
the next peaks after it, as two parallel arrays, the pair's frame number and its hash
(bin, later bin, distance in frames).

Defined results: a null or empty text has a payload of 64 zero bytes, which has no peak, so its
arrays are empty; equal texts have equal values; repeated rows come out repeated; an empty table
gives an empty result. Long files are transformed in blocks of frames, so memory is bounded by
the file itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT, RATE = 64, 8000
FRAME, HOP, BLOCK = 512, 256, 4096
#: Bands are bins EDGES[i]..EDGES[i+1]-1 of the spectrum.
EDGES = (1, 8, 32, 96, FRAME // 2 + 1)
#: A peak is the largest of its band over so many frames to either side; it is paired with FAN later ones within REACH frames.
NEAR, FAN, REACH = 3, 3, 63
_WINDOW = np.hanning(FRAME)

STORED_SQL = "doc_id long, n_bytes long, media binary"
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_hash array<int>"


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, rate, len(samples), "NONE", "not compressed"))
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored)) as w:
        return w.readframes(w.getnframes())


def spectrum_bands(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every frame (of FRAME samples, HOP apart, the last filled up with silence) and band: the
    largest power and its bin. Constant offset does not count."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    power, at = np.empty((n, len(EDGES) - 1)), np.empty((n, len(EDGES) - 1), np.int32)
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        part = samples[first * HOP : (last - 1) * HOP + FRAME].astype(np.float64)
        part = np.pad(part, (0, (last - first - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        found = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _WINDOW)
        found = found.real**2 + found.imag**2
        for b in range(len(EDGES) - 1):
            cut = found[:, EDGES[b] : EDGES[b + 1]]
            best = cut.argmax(axis=1)
            at[first:last, b] = best + EDGES[b]
            power[first:last, b] = cut[np.arange(len(cut)), best]
    return power, at


def peaks(power: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the peaks, by frame and bin. Of equal neighbours the first is the peak."""
    top = power > 1e-6
    for d in range(1, NEAR + 1):
        top[d:] &= power[d:] > power[:-d]
        top[:-d] &= power[:-d] >= power[d:]
    t, b = np.nonzero(top)
    return t, at[t, b]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and hashes of all peak pairs, by time."""
    t, f = peaks(*spectrum_bands(samples))
    times, hashes = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        times.append(t[:-k][near])
        hashes.append((f[:-k][near] << 15 | f[k:][near] << 6 | gap[near]))
    time, hashed = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hashed, time))
    return time[order].astype(np.int32), hashed[order].astype(np.int32)


def _slices(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for first in range(0, part.num_rows, rows):
            yield part.slice(first, rows)


def _wavs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(parts):
        texts = [(t or "").encode() for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())], schema=STORED)


def _described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for part in _slices(parts):
        rows = []
        for i, n, stored in zip(*(c.to_pylist() for c in part.columns)):
            payload = from_wav(stored)
            time, hashed = fingerprint(np.frombuffer(payload, np.uint8))
            feature = f"{len(time)}:{hashlib.sha1(time.tobytes() + hashed.tobytes()).hexdigest()}"
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, time, hashed))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the table doc_id, n_bytes (of the text), media (a WAV file) for ``docs`` (doc_id, text) into ``folder`` and reads it."""
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_wavs, STORED_SQL).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(STORED_SQL).parquet(folder)


def features(media: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of a stored table (doc_id, n_bytes, media)."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_described, SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of ``docs`` (doc_id, text), from the stored media."""
    return features(store(docs, common.shared_dir(docs.sparkSession, "media")))
