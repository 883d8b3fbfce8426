"""Near-duplicate documents: MinHash LSH forest, exact confirmation, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, hidden, keep, minhash, permutations, shingles, split_by_bytes, words_of
from .forest import LEVELS, forest_components, forest_pairs, linked_components

#: Ids up to so many are sent to every executor; beyond, the text is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text, without repeats."""
    words, at = words_of(texts)
    return [np.unique(shingles(words[s:e], width)) for s, e in zip(at[:-1], at[1:])]


def signatures(rows: DataFrame, width: int, trees: int, seed: int = 8) -> DataFrame:
    """(key, n, d1, d2, paths) of rows (key, text): set size, digest of the set (null if empty), one path per tree."""
    a, b = permutations(trees * LEVELS, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch):
                sets = shingle_sets(part.column("text"), width)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                paths = np.zeros((len(sets), trees), np.uint64)
                if len(some):
                    starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    least = minhash(np.concatenate([sets[i] for i in some]), starts, a, b)
                    least = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint64).reshape(len(some), trees, LEVELS)
                    for level in range(LEVELS):
                        paths[some] |= least[:, :, level] << np.uint64(8 * (LEVELS - 1 - level))
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None for s in sets]
                halves = [pa.array([None if d is None else int(np.uint64(d >> k & (2**64 - 1)).astype(np.int64)) for d in digests], pa.int64()) for k in (64, 0)]
                offsets = pa.array(np.arange(len(sets) + 1) * trees, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n), *halves, pa.ListArray.from_arrays(offsets, pa.array(paths.view(np.int64).ravel()))], ["key", "n", "d1", "d2", "paths"])
        give_back()

    return rows.mapInArrow(run, "key bigint, n bigint, d1 bigint, d2 bigint, paths array<bigint>")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80, trees: int = 24, depth: int = 5, window: int = 12, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links, itself included), kept (key = component_id).

    Words: ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Two documents link if the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``percent`` / 100; shorter texts are one shingle. Null and empty texts link with
    nothing. Documents with equal sets form a class, and one of each class goes through the forest. Every link is confirmed on
    the full sets, in regions of any size. A pair at similarity s shares a region with probability 1 - (1 - s**depth)**trees,
    .9999 at .8.
    Repeated rows each keep a row; rows that share a key are one document. A row with a null key has a null
    component and is kept.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    signed = keep(signatures(rows, width, trees))
    # exchanges of their own: adaptive execution can then split the join where a class holds many rows
    classes = signed.where("d1 is not null and key is not null").groupBy("d1", "d2").agg(F.min("key").alias("rep")).withColumn("d1", hidden("d1"))
    placed = keep(signed.join(classes, ["d1", "d2"], "left").select("key", "n", "rep", F.when(F.col("key") == F.col("rep"), F.col("paths")).alias("paths")))
    forget(signed)
    reps = placed.where("paths is not null")
    entries = keep(reps.select("n", F.col("key").alias("id"), F.posexplode("paths").alias("tree", "path")))
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // 4096))
    pairs = keep(forest_pairs(entries, depth, window, percent, parts))
    comp = linked_components(pairs, rows, lambda texts: shingle_sets(texts, width), percent)
    comp = forest_components(entries, comp, rows, lambda texts: shingle_sets(texts, width), depth, window, percent, trees)
    forget(entries)
    by_class = comp.select(F.col("node").alias("rep"), "component")
    out = placed.select("key", "n", "rep").join(by_class, "rep", "left")
    found = F.coalesce("component", "rep", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("key") == found, F.lit(True)).alias("kept"))
