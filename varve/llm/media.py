"""Media columns: bytes as 8-bit WAV, read back by the wave module, and spectral-peak pair fingerprints."""

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

from .common import split_by_bytes

#: The payload is padded to a positive multiple of FRAME bytes with PAD; one STFT window is a frame.
FRAME, PAD, RATE = 576, b"\xff", 8000
HOP = FRAME // 2
#: Spectral bands, one peak each; bin 0 is the mean.
BANDS = ((1, 24), (24, 96), (96, FRAME // 2 + 1))
#: A peak pairs with peaks (frames ahead, bands ahead).
TARGETS = ((0, 1), (1, 1), (2, 0))
_WINDOW = np.hanning(FRAME + 1)[:-1]


def pad(data: bytes) -> bytes:
    return data + PAD * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray, block: int = 512) -> np.ndarray:
    """(frames, bands) bins of the largest magnitude (the lowest of equals; magnitudes to 1e-6), -1 in a silent band.

    Frames overlap by half. Blocks of frames bound the memory whatever the length.
    """
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), block):
        power = np.abs(np.fft.rfft((frames[i : i + block].astype(np.float64) - 128.0) * _WINDOW, axis=1))
        np.round(power, 6, out=power)
        for k, (lo, hi) in enumerate(BANDS):
            at = power[:, lo:hi].argmax(axis=1)
            out[i : i + block, k] = np.where(power[np.arange(len(at)), lo + at] > 0, lo + at, -1)
    return out


def time_codes(found: np.ndarray) -> np.ndarray:
    """Pairs of peaks as sorted int64: frame << 24 | bin << 14 | later bin << 4 | frames between."""
    out = []
    for ahead, bands in TARGETS:
        for k in range(len(BANDS)):
            a, b = found[: len(found) - ahead, k], found[ahead:, (k + bands) % len(BANDS)]
            t = np.flatnonzero((a >= 0) & (b >= 0))
            out.append(t << 24 | a[t] << 14 | b[t] << 4 | ahead)
    return np.sort(np.concatenate(out))


def media_columns(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media (WAV bytes) and codes (array of time-coded peak pairs).

    Payload columns and codes come from the stored bytes as read back. A null text is empty: one frame of
    padding. Repeated rows each keep a row. Equal texts have equal values. A single row's bytes are the unit of memory.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "codes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch):
                out = []
                for value in part.column("text"):
                    data = (value.as_py() or "").encode()
                    stored = to_wav(pad(data))
                    payload = from_wav(stored)
                    out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), stored, time_codes(peaks(np.frombuffer(payload, np.uint8)))))
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["key", *names])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media binary, codes array<bigint>")
    return out.select(F.col("key").alias(key), *names)
