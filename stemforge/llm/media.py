"""Media columns: WAV storage, short-time Fourier transforms and spectral-peak pair fingerprints.

`store_wav` turns bytes into a lossless WAV column (8-bit mono samples); `fingerprint` reads that
column with the wave module and derives landmarks. A landmark pairs two spectral peaks and is stored
as one long: time << 24 | first bin << 16 | second bin << 8 | time distance.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 8000
#: Spectrum bins of each band; the strongest bin of a band is a frame's candidate peak.
BANDS = ((2, 20), (20, 48), (48, 96), (96, 192))
#: A peak is the strongest of its band within this many frames; pairs span at most REACH frames.
NEAR = 6
REACH = 48
FANOUT = 2
#: Frames transformed at once.
BLOCK_FRAMES = 16384


def pad(payload: bytes) -> bytes:
    """Append bytes 32 up to a positive multiple of UNIT."""
    return payload.ljust(max(1, -(-len(payload) // UNIT)) * UNIT, b" ")


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _band_peaks(samples: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each band and its level, for a frame of 2 * UNIT samples at every UNIT.

    `samples` has UNIT columns; a row marked `fresh` starts another item, whose samples no earlier frame sees.
    """
    n = len(samples)
    window = np.hanning(2 * UNIT).astype(np.float32)
    bins = np.empty((n, len(BANDS)), np.int64)
    level = np.empty((n, len(BANDS)), np.int64)
    for a in range(0, n, BLOCK_FRAMES):
        b = min(n, a + BLOCK_FRAMES)
        x = np.zeros((b - a, 2 * UNIT), np.float32)
        x[:, :UNIT] = samples[a:b]
        m = min(b, n - 1) - a
        x[:m, UNIT:] = samples[a + 1 : a + 1 + m]
        x[:, :UNIT] -= 128
        x[:, UNIT:] -= 128
        ends = np.append(fresh[a + 1 : b], True if b >= n else fresh[b])
        x[ends, UNIT:] = 0
        x *= window
        spectrum = np.fft.rfft(x, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for k, (lo, hi) in enumerate(BANDS):
            part = power[:, lo:hi]
            best = part.argmax(1)
            bins[a:b, k] = best + lo
            level[a:b, k] = np.log2(part[np.arange(b - a), best] + 1) * 16
    return bins, level


def landmarks(items: list[bytes]) -> list[np.ndarray]:
    """Landmarks of each item (sample bytes, a multiple of UNIT), in order of time."""
    frames = np.array([len(x) // UNIT for x in items], np.int64)
    first = np.cumsum(frames) - frames
    samples = np.frombuffer(b"".join(items), np.uint8).reshape(-1, UNIT)
    fresh = np.zeros(len(samples), bool)
    fresh[first] = True
    item = np.repeat(np.arange(len(items)), frames)
    bins, level = _band_peaks(samples, fresh)
    peak = np.ones_like(level, bool)
    for d in range(1, NEAR + 1):  # of equal levels the earlier one is the peak
        if d < len(level):
            same = (item[d:] == item[:-d])[:, None]
            peak[:-d] &= (level[:-d] >= level[d:]) | ~same
            peak[d:] &= (level[d:] > level[:-d]) | ~same
    t, k = np.nonzero(peak)
    f, own, at = bins[t, k], item[t], t - first[item[t]]
    times, codes, owners = [], [], []
    for d in range(1, FANOUT + 1):
        if len(t) > d:
            gap = at[d:] - at[:-d]
            ok = (own[d:] == own[:-d]) & (gap <= REACH)
            codes.append((f[:-d][ok] << 16) | (f[d:][ok] << 8) | gap[ok])
            times.append(at[:-d][ok])
            owners.append(own[:-d][ok])
    if not times:
        return [np.zeros(0, np.int64) for _ in items]
    who, marks = np.concatenate(owners), (np.concatenate(times) << 24) | np.concatenate(codes)
    order = np.lexsort((marks, who))
    bounds = np.searchsorted(who[order], np.arange(len(items) + 1))
    return [marks[order[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def store_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty) as UTF-8 bytes in a WAV file.

    Columns besides the two named are not read. A task holds the texts and files of one Arrow batch, so a
    very long text takes about three times its bytes.
    """

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprint(media: DataFrame) -> DataFrame:
    """Read each WAV of a media column back: payload digests and landmarks.

    Input: doc_id, n_bytes, media. Output: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32
    (of the last 16 payload bytes), media_bytes, media_sha256, landmarks array<long>. Rows are
    independent, so repeated rows give equal results; an empty text is 192 bytes of padding and has
    landmarks like any other, possibly none; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            ids, sizes, col = b.column(0), b.column(1), b.column(2)
            for a in range(0, len(col), 512):
                wavs = col.slice(a, 512).to_pylist()
                got = [from_wav(w) for w in wavs]
                marks = landmarks(got)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, 512),
                        sizes.slice(a, 512),
                        pa.array([len(p) for p in got], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in got], pa.string()),
                        pa.array([zlib.crc32(p[-16:]) for p in got], pa.int64()),
                        pa.array([len(w) for w in wavs], pa.int64()),
                        pa.array([hashlib.sha256(w).hexdigest() for w in wavs], pa.string()),
                        pa.array(marks, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "landmarks"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, landmarks array<bigint>")


def feature_text(marks: Column) -> Column:
    """Landmarks as hexadecimal text, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.hex(m)), ",")
