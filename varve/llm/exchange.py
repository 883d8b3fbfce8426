"""Fixed-width rows that travel between tasks as packed columns, combined before they are sent.

Each task folds its rows in chunks (a group that holds a large share of all rows shrinks to a few rows per chunk), deals
them to buckets by their first column, and sends one blob per bucket and chunk. A receiving task holds all rows of its
buckets, so every group of equal first columns is whole there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyfilter import FILTER_BITS, KEY_BITS, KeyFilter, key_filter  # noqa: F401
from .common import batches_of, give_back, keep, mix, split_by_bytes

#: Bytes of rows that a task folds, or looks through, together; whole groups may be larger.
CHUNK_BYTES = 6 << 20
#: Bytes of blobs in one Arrow batch, and rows of any batch.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 64
#: Bytes of text for each receiving task, where the session has fewer shuffle partitions.
TASK_BYTES = 32 << 20


def tasks_for(rows: DataFrame, text: str = "text") -> int:
    """Receiving tasks for rows made of ``text``: the session's shuffle partitions, more where the texts are many."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _unpack(blobs: list, kinds: list) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    size, columns = sum(k.itemsize for k in kinds), [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // size, 0
        for column, kind in zip(columns, kinds):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * kind.itemsize
    return [np.concatenate(c) for c in columns]


def _whole(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` bytes at least, but for the last."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def exchange(rows: DataFrame, make: Callable, fold: Callable, scan: Callable, kinds: list[str], found: str, parts: int) -> DataFrame:
    """A written table of results of type ``found`` (names and types, all bigint) of groups of equal first columns.

    ``make(batch)`` yields (kind of row, columns); ``fold(kind, columns)`` gives (results known at once, columns to send, sorted by
    the second); ``scan(kind, columns)`` gives the results of whole groups, some of a bucket's at a time. Results are lists of
    int64 arrays.
    """
    chunk = CHUNK_BYTES // sum(np.dtype(k).itemsize for k in kinds)
    names = [c.split()[0] for c in found.split(", ")]
    # a bucket for each task: the numbers that Spark's hash sends to each of them
    seats, number = {}, 0
    while len(seats) < parts:
        more = rows.sparkSession.range(number, number + 16 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("task")).collect()
        number += 16 * parts
        for r in more:
            seats.setdefault(r.task, r.id)
    seats = np.array([seats[k] for k in range(parts)], np.int64)

    def blobs(kind: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        bucket = ((columns[0] >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        columns, bucket = [c[order] for c in columns], bucket[order]
        cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(seats[bucket[s]]), kind, b"".join(np.ascontiguousarray(c[s:e]).tobytes() for c in columns)

    def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        bucket, kind, blob = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine, held, size = TaskContext.get().partitionId(), {}, {}

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            known, columns = fold(kind, [np.concatenate(c) for c in zip(*held.pop(kind))])
            size[kind] = 0
            out = list(blobs(kind, columns)) if len(columns[0]) else []
            if known and len(known[0]):
                out.append((int(seats[mine % parts]), -1, b"".join(k.astype(np.int64).tobytes() for k in known)))
            size_of = np.cumsum([len(blob) for _, _, blob in out]) // BATCH_BYTES
            for k in np.unique(size_of):
                yield batch_of([out[i] for i in np.flatnonzero(size_of == k)])

        for batch in _whole(batches):
            for part in split_by_bytes(batch):
                for kind, columns in make(part):
                    if len(columns[0]):
                        held.setdefault(kind, []).append(columns)
                        size[kind] = size.get(kind, 0) + len(columns[0])
                        if size[kind] >= chunk:
                            yield from flush(kind)
        for kind in list(held):
            yield from flush(kind)
        give_back()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names)
        held = {}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
                if kind < 0:
                    yield as_batch(_unpack([blob], ["<i8"] * len(names)))
                else:
                    held.setdefault(kind, []).append(blob)
        for kind in list(held):
            columns = _unpack(held.pop(kind), kinds)
            pieces = -(-len(columns[0]) // chunk)
            piece = mix(columns[0]) % np.uint64(pieces)
            for k in range(pieces):
                out = scan(kind, [c[piece == k] for c in columns] if pieces > 1 else columns)
                for s in range(0, len(out[0]), 65536):
                    yield as_batch([c[s : s + 65536] for c in out])
            del columns, piece
        give_back()

    sent = rows.mapInArrow(send, "bucket bigint, kind int, blob binary")
    # blobs are large, and so may texts be
    with batches_of(rows.sparkSession, BATCH_ROWS):
        return keep(sent.repartition(parts, "bucket").select("kind", "blob").mapInArrow(receive, found))
