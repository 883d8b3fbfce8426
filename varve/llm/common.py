"""Helpers that the operators share: scratch tables, word hashing, MinHash, connected components.

A scratch table is a Parquet folder under ``spark.checkpoint.dir``, which driver and
executors share. It cuts lineage, and it outlives any executor.
"""

from __future__ import annotations

import ctypes
import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import TEXT_ROWS, keep, scratch_root, text_batches  # noqa: F401


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while the plans inside run, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def give_back() -> None:
    """Return this worker's unused memory to the system: workers outlive their tasks, and an executor counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written into the plan, without any Python on executors."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    parsed = F.from_json(F.lit(text), "array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", ")) + ">>")
    return spark.range(1, numPartitions=1).select(F.inline(parsed))


# ---------------------------------------------------------------- words and shingles


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; bytes.lower and bytes.split know just ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bytes hashed at a time; longer words are hashed one by one.
SEGMENT, LONG_WORD = 1 << 18, 1 << 12
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _byte_values() -> np.ndarray:
    """A random number for each byte; the same for a letter of A-Z and its small one."""
    out = np.random.default_rng(1).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


_VALUES, _SPACES = _byte_values(), np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in order, where each text's words start, and their number at the end).

    Words are those of ``ascii_words``; a null text has none. Hashes are differences of prefix sums over the bytes.
    """
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    at = at - at[0]
    space = np.concatenate((_SPACES[raw], np.ones(1, bool)))
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at] = True
    before = np.concatenate((np.ones(1, bool), space[:-1]))
    start = np.flatnonzero(~space & (before | fresh))
    end = np.flatnonzero(~before & (space | fresh))
    out = np.empty(len(start), np.uint64)
    long = end - start > LONG_WORD
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes().lower())
    power, back = powers(SEGMENT + LONG_WORD + 1)
    k = 0
    while k < len(start):
        first = start[k]
        stop = max(k + 1, int(np.searchsorted(start, first + SEGMENT)))
        some = np.arange(k, stop)[~long[k:stop]]
        if len(some):
            part = _VALUES[raw[first : end[some[-1]]]]
            part *= power[: len(part)]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
            s, e = start[some] - first, end[some] - first
            out[some] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        k = stop
    return out, np.searchsorted(start, at)


def word_ids(words: list[bytes]) -> np.ndarray:
    """The same hashes of a list of words."""
    return words_of(pa.array([b" ".join(words).decode("utf-8", "surrogatepass")]))[0]


def split_by_bytes(batch: pa.RecordBatch, column: str = "text", size: int = 2 * SEGMENT, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with texts of about ``size`` bytes, one row at least."""
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(n, (n[at - 1] if at else 0) + size))
        stop = min(max(at + 1, stop), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the input reaches every bit of the output."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_ODD = np.random.default_rng(20240229).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; shorter sequences are one shingle, none gives none."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        h = np.array([n], np.uint64)
        for i in range(n):
            h = mix(h * _ODD[15] + ids[i : i + 1])
        return h
    h = ids[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        h += ids[k : n - width + 1 + k] * _ODD[k]
    return mix(h)


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, count, dtype=np.uint32)


def minhash(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(segments, permutations) minima of ``a * h + b`` mod 2**32 over each segment of ``flat``; none may be empty."""
    low = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(a)), np.uint32)
    for j in range(len(a)):
        out[:, j] = np.minimum.reduceat(low * a[j] + b[j], starts)
    return out


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| for sorted arrays without repeats; two empty sets never match."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


# ---------------------------------------------------------------- connected components


def hidden(name: str) -> Column:
    """A bigint column that the planner doesn't know to be one: a join on it gets an exchange of its own."""
    return F.bitwise_not(F.bitwise_not(name))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stop changing. Every step is a
    grouped minimum, which combines before its shuffle, and a join that adaptive execution can split, so
    a node with a large share of all edges is no bottleneck. Nothing but two numbers reaches the driver. Raises if
    ``rounds`` are not enough; the number needed grows with the logarithm of the longest path.
    """
    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        # an exchange of its own: adaptive execution splits a join only where both sides come straight from a shuffle
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).withColumn("u", hidden("u"))
        out = both.join(low, "u")
        out = out.where("v > u") if large else out
        linked = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            linked = linked.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return linked.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    cur = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(cur)
    for _ in range(rounds if seen[0] else 0):
        new = keep(step(step(cur, True), False))
        now = state(new)
        forget(cur)
        cur, before, seen = new, seen, now
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that span the same components of ``n`` nodes as the given edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


