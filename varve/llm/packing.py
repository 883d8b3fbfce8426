"""Packing: documents as token pieces in sequences, by first-fit decreasing on a tournament tree.

A document longer than a sequence is cut at multiples of the sequence length; its full pieces each fill a
sequence, and its last piece is packed with those of other documents. Pieces are dealt at random into groups
of bounded size, which are packed independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import give_back
from .tokens import default_path

#: Bins of one group have ids group * 2**GROUP_BITS + bin.
GROUP_BITS = 24


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. A tree holds the most room in each half; the leftmost bin with room is found from its top.

    Ties go in the given order. Every length must be at most ``capacity``.
    """
    n = len(lengths)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def token_pieces(
    docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2, keep_ids: bool = False
) -> DataFrame:
    """Pieces of each document's ids with ``end_id`` after them: key, start, length, ids_crc32, doc_tokens [, ids as little-endian bytes]."""
    path = path or default_path()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda ids: np.array(ids, "<u4").tobytes()
        memo, specials, whole = pretoken.Memo(path, packed), pretoken.special_strings(path), pretoken.tokenizer(path).encode
        found, last = memo.__getitem__, packed([end_id])
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for k, value in enumerate(part.column("text")):
                    t = value.as_py() or ""
                    words = pretoken.split(t, specials)
                    buf = (packed(whole(t, add_special_tokens=False).ids) if words is None else b"".join(map(found, words))) + last
                    n = len(buf) // 4
                    for s in range(0, n, capacity):
                        piece = buf[4 * s : 4 * (s + capacity)]
                        row.append(k), start.append(s), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                        if keep_ids:
                            ids.append(piece)
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row, pa.int64())), *longs, *([pa.array(ids, pa.binary())] if keep_ids else [])], names)
        give_back()

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if keep_ids else "")
    return rows.mapInArrow(run, schema)


def pack(
    docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2, group_rows: int = 8192, task_rows: int = 200_000, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    Null and empty texts are documents of the one id ``end_id``. Repeated rows are documents of their
    own, each with its pieces. Null keys are kept. Offsets within a sequence start at 0 without gaps, and no
    sequence holds more than ``capacity`` ids. Groups are dealt by a hash of a piece; a task packs at most
    ``group_rows`` pieces at a time, so a piece that repeats without end can't fill a worker's memory. Only
    pieces travel, not texts or (unless ``keep_ids``) ids.
    """
    pieces = token_pieces(docs, path, key=key, text=text, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    names = pieces.columns
    rows = docs.count()
    parts = max(1, -(-rows // task_rows), min(-(-rows // group_rows), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = pieces.withColumn("deal", F.xxhash64("key", "start", "ids_crc32", F.lit(7)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            t = pa.Table.from_batches(held)
            b, o = first_fit_decreasing(t.column("length").to_numpy(), capacity)
            ids = (np.int64(task) << np.int64(20) | np.int64(block)) * np.int64(1 << GROUP_BITS) + b
            return t.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(o, pa.int64())).to_batches()

        for batch in batches:
            for part in (batch.slice(i, group_rows) for i in range(0, batch.num_rows, group_rows)):
                held.append(part)
                rows += part.num_rows
                if rows >= group_rows:
                    yield from flush()
                    block, held, rows = block + 1, [], 0
        if held:
            yield from flush()

    kind = pieces.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if keep_ids else "") + ", sequence_id bigint, offset bigint"
    # in order within a task, so that a task that runs again makes the same sequences
    order = ["deal", "key", "start", "length", "ids_crc32"]
    out = dealt.repartition(parts, "deal").sortWithinPartitions(*order).drop("deal").mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), *names[1:], "sequence_id", "offset")
