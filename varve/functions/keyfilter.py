"""A Bloom filter of 64-bit keys, made in tasks and sent to executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter for each key, at least and as wished, and at most; beyond, the keys are joined to their rows instead.
KEY_BITS, WISHED_BITS, FILTER_BITS = 10, 24, 1 << 29
#: Bits that a key sets, by the bits that there are for each key.
PLACES = ((24, 8), (16, 6), (0, 4))


class KeyFilter:
    """A Bloom filter: keys that were put in are always found, others rarely."""

    def __init__(self, bits: int, words: np.ndarray | None = None, places: int = 3):
        self.mask, self.places = np.uint64(bits - 1), places
        self.words = np.zeros(bits >> 3, np.uint8) if words is None else words

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return ((keys + np.uint64(k) * step) & self.mask for k in range(self.places))

    def add(self, keys: np.ndarray) -> None:
        for place in self._places(keys):
            np.bitwise_or.at(self.words, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        step = (keys >> np.uint64(32)) | np.uint64(1)
        for k in range(self.places):
            # only keys that all places so far hold are looked at again
            place = (keys[left] + np.uint64(k) * step[left]) & self.mask
            left = left[(self.words[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        out[left] = True
        return out


_SLICE = 1 << 16


def key_filter(keys: DataFrame, count: int) -> KeyFilter:
    """The filter of a column of ``count`` bigint keys: made by slices in the tasks, and joined; its size is bounded by FILTER_BITS."""
    bits = 1 << 13
    while bits < min(count * WISHED_BITS, FILTER_BITS):
        bits *= 2
    places = next(n for least, n in PLACES if bits >= count * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = KeyFilter(bits, places=places)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        some = [(i, own.words[i * _SLICE : (i + 1) * _SLICE]) for i in range(-(-len(own.words) // _SLICE))]
        some = [(i, w.tobytes()) for i, w in some if w.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([w for _, w in some], pa.binary())], ["slice", "words"])

    def join(table: pa.Table) -> pa.Table:
        words = None
        for w in table.column("words"):
            w = np.frombuffer(w.as_buffer(), np.uint8)
            words = w.copy() if words is None else np.bitwise_or(words, w, out=words)
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

    out = np.zeros(bits >> 3, np.uint8)
    for r in keys.coalesce(32).mapInArrow(run, "slice bigint, words binary").groupBy("slice").applyInArrow(join, "slice bigint, words binary").collect():
        out[r.slice * _SLICE : r.slice * _SLICE + len(r.words)] = np.frombuffer(r.words, np.uint8)
    return KeyFilter(bits, out, places)
