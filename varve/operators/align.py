"""Ancestors in an archive: banded candidates, channel containment, window alignment with order, classification."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyfilter import FILTER_BITS, KEY_BITS, key_filter
from . import sketch

#: Relations under which a document descends from the reference. (fixed values)
ANCESTRAL = ("identical", "near_dup", "derived", "contained_by")


@dataclass(frozen=True)
class AlignConfig:
    """(fixed values)"""

    bands: int = 32
    rows: int = 4
    channels: tuple[str, ...] = ("word", "rare", "num")
    near_dup: float = 0.80
    excerpt: float = 0.60
    gap: float = 0.20
    rare: float = 0.42
    num: float = 0.40
    char: float = 0.10
    least_channels: int = 2
    window: float = 0.30
    order: float = 0.60
    candidates: int = 256
    confidence: float = 0.55
    least_tokens: int = 24


def band_keys(prints: DataFrame, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """(doc_id, band, key): each channel's signature in bands; empty channels give none."""
    def keys(c: str) -> Column:
        band = lambda i: F.struct(F.concat(F.lit(f"{c}:"), i.cast("string")).alias("band"), F.xxhash64(F.slice(F.col(f"m_{c}"), i * cfg.rows + 1, cfg.rows)).alias("key"))
        made = F.transform(F.sequence(F.lit(0), F.lit(cfg.bands - 1)), band)
        return F.when(F.col(f"n_{c}") > 0, made).otherwise(F.array().cast("array<struct<band:string,key:bigint>>"))

    parts = [keys(c) for c in cfg.channels]
    return prints.select("doc_id", F.explode(F.concat(*parts)).alias("b")).select("doc_id", "b.band", "b.key")


def window_keys(windows: DataFrame, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """(doc_id, band, key, n): each window's sketch in bands of two slots, with the number of the document's windows that have it."""
    band = lambda i: F.struct(F.concat(F.lit("window:"), i.cast("string")).alias("band"), F.xxhash64(F.slice("minhash", i * 2 + 1, 2)).alias("key"))
    made = windows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cfg.bands - 1)), band)).alias("b"))
    return made.groupBy("doc_id", "b.band", "b.key").agg(F.count("*").alias("n"))


_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def _band_rows(prints: DataFrame, cfg: AlignConfig, windows: bool, found=None) -> DataFrame:
    """(doc_id, key, n): the bands of a document and of its windows, each key once with its number; ``found`` is a broadcast filter of keys."""
    columns = ["doc_id", *[f"{k}_{c}" for c in cfg.channels for k in "nm"], *(["w"] if windows else [])]
    rows = prints.select(*columns)

    def keys(values: np.ndarray, slots: int, first: int) -> np.ndarray:
        """Keys of rows of signatures, ``slots`` to a band."""
        cut = values[:, : cfg.bands * slots].reshape(len(values), cfg.bands, slots).astype(np.uint64)
        h = np.arange(first, first + cut.shape[1], dtype=np.uint64) * _ODD[63] + _ODD[62]
        for j in range(slots):
            h = _mixed(h ^ (cut[:, :, j] + _ODD[j]))
        return h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            number, h = [], []
            at = np.arange(batch.num_rows)
            for i, c in enumerate(cfg.channels):
                some = batch.column(f"n_{c}").to_numpy(zero_copy_only=False) > 0
                m = batch.column(f"m_{c}").flatten().to_numpy(zero_copy_only=False).reshape(-1, sketch.SLOTS)[some]
                k = keys(m, cfg.rows, i * cfg.bands)
                h.append(k.ravel()), number.append(np.repeat(at[some], k.shape[1]))
            if windows:
                m = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, sketch.WINDOW_SLOTS)
                k = keys(m, 2, len(cfg.channels) * cfg.bands)
                many = np.diff(batch.column("w").offsets.to_numpy()) // sketch.WINDOW_SLOTS
                h.append(k.ravel()), number.append(np.repeat(np.repeat(at, many), k.shape[1]))
            h, number = np.concatenate(h), np.concatenate(number)
            if found is not None:
                some = found.value.has(h)
                h, number = h[some], number[some]
            order = np.lexsort((h, number))
            h, number = h[order], number[order]
            fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (number[1:] != number[:-1]))))
            n = np.diff(np.append(fresh, len(h)))
            ids = batch.column("doc_id").take(pa.array(number[fresh], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h[fresh].view(np.int64)), pa.array(n, pa.int64())], ["doc_id", "key", "n"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, n bigint")


def _collisions(queries: DataFrame, archive: DataFrame, cfg: AlignConfig, with_windows: bool, wanted: Column | None) -> DataFrame:
    """(q_id, r_id, hits): shared bands of documents, and of any window of one with any of the other, counted as often as they occur.

    A filter of the queries' keys goes to where the archive's are made, so only those that queries may have travel.
    """
    left = _band_rows(queries, cfg, with_windows)
    count = left.count()
    found = queries.sparkSession.sparkContext.broadcast(key_filter(left.select("key"), max(count, 1))) if count * KEY_BITS <= FILTER_BITS else None
    right = _band_rows(archive, cfg, with_windows, found)
    both = left.withColumnsRenamed({"doc_id": "q_id", "n": "q_n"}).join(right.withColumnsRenamed({"doc_id": "r_id", "n": "r_n"}), "key")
    if wanted is not None:
        both = both.where(wanted)
    return both.groupBy("q_id", "r_id").agg(F.sum(F.col("q_n") * F.col("r_n")).alias("hits"))


def candidates(queries: DataFrame, archive: DataFrame, cfg: AlignConfig = AlignConfig(), windows: bool = True, wanted: Column | None = None) -> DataFrame:
    """(q_id, r_id, exact, hits): equal texts, all of them, and the ``cfg.candidates`` other pairs of a query with most shared bands.

    Window bands find a quotation in a long document, which bands of whole documents don't. ``wanted``, a condition on q_id and
    r_id, is applied before the best are taken. The bound on candidates is part of the operator; without one (0) all pairs are kept.
    """
    asked = queries.where(F.col("n_tokens") >= cfg.least_tokens)
    exact = asked.select(F.col("doc_id").alias("q_id"), "sha256").join(archive.select(F.col("doc_id").alias("r_id"), "sha256"), "sha256").select("q_id", "r_id", F.lit(1).alias("exact"), F.lit(0).cast("bigint").alias("hits"))
    exact = exact if wanted is None else exact.where(wanted)
    near = _collisions(asked, archive, cfg, windows, wanted).select("q_id", "r_id", F.lit(0).alias("exact"), "hits")
    both = exact.unionByName(near).where("q_id <> r_id").groupBy("q_id", "r_id").agg(F.max("exact").alias("exact"), F.max("hits").alias("hits"))
    if not cfg.candidates:
        return both
    best = Window.partitionBy("q_id", "exact").orderBy(F.desc("hits"), "r_id")
    return both.withColumn("n", F.row_number().over(best)).where((F.col("exact") == 1) | (F.col("n") <= cfg.candidates)).drop("n")


def _compared(pairs: DataFrame, queries: DataFrame, archive: DataFrame, windows: bool, small: bool, threshold: float) -> DataFrame:
    """Pairs with both sides' hashes and cardinalities, e_<channel> (equal slots), and the windows' alignment if asked for.

    Each signature travels once to its pairs: the archive's by a join on its id, those of ``small`` queries by a broadcast.
    """
    side = lambda df, p: df.select(F.col("doc_id").alias(f"{p}_id"), F.col("sha256").alias(f"{p}_sha"), *[F.col(f"{k}_{c}").alias(f"{p}{k}_{c}") for c in sketch.WEIGHTS for k in "nm"], *([F.col("w").alias(f"{p}w")] if windows else []))
    left, right = side(queries, "q"), side(archive, "r")
    rows = pairs.join(right, "r_id").join(F.broadcast(left) if small else left, "q_id")
    made = [f"e_{c}" for c in sketch.WEIGHTS]
    gone = {f"{p}m_{c}" for c in sketch.WEIGHTS for p in "qr"} | {"qw", "rw"}
    sent = [c for c in rows.columns if c not in gone]
    extra = ["coverage_q", "coverage_r", "matched", "order"] if windows else []
    kinds = {"coverage_q": "double", "coverage_r": "double", "matched": "bigint", "order": "double"}
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in sent] + [f"{c} bigint" for c in made] + [f"{c} {kinds[c]}" for c in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
            equal = [pa.array((flat(f"qm_{c}") == flat(f"rm_{c}")).reshape(-1, sketch.SLOTS).sum(axis=1), pa.int64()) for c in sketch.WEIGHTS]
            found = []
            if windows:
                cut = lambda c: np.split(flat(c).reshape(-1, sketch.WINDOW_SLOTS), np.cumsum(np.diff(batch.column(c).offsets.to_numpy()) // sketch.WINDOW_SLOTS)[:-1])
                out = [_aligned(q, r, threshold) for q, r in zip(cut("qw"), cut("rw"))]
                found = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in sent), *equal, *found], [*sent, *made, *extra])

    return rows.mapInArrow(run, schema)


def _scored(rows: DataFrame) -> DataFrame:
    col = F.col
    share = {c: col(f"e_{c}") / F.lit(float(sketch.SLOTS)) for c in sketch.WEIGHTS}
    rows = rows.withColumns({f"ch_{c}": sketch.containment(share[c], col(f"qn_{c}"), col(f"rn_{c}")) for c in sketch.WEIGHTS})
    rows = rows.withColumn("rev_word", sketch.containment(share["word"], col("rn_word"), col("qn_word")))
    more = [c for c in ("coverage_q", "coverage_r", "matched", "order") if c in rows.columns]
    return rows.select("q_id", "r_id", "exact", "hits", (col("q_sha") == col("r_sha")).alias("same"), *[f"ch_{c}" for c in sketch.WEIGHTS], "rev_word", *more)


def channel_scores(pairs: DataFrame, queries: DataFrame, archive: DataFrame, small: bool = False) -> DataFrame:
    """Adds ch_<channel> (query in reference) and rev_word (reference in query), and both hashes; ``small`` queries are broadcast."""
    return _scored(_compared(pairs, queries, archive, False, small, 0.0))


def longest_run(indices: list[int]) -> int:
    """Length of the longest subsequence that never falls: the least possible last value of each length, kept sorted."""
    tails: list[int] = []
    for x in indices:
        i = bisect_right(tails, x)
        tails[i : i + 1] = [x]
    return len(tails)


def _aligned(q: np.ndarray, r: np.ndarray, threshold: float) -> tuple[float, float, int, float]:
    """(coverage_q, coverage_r, matched, order) of windows: each of the query against all of the reference's."""
    if not len(q) or not len(r):
        return 0.0, 0.0, 0, 0.0
    rows = max(1, (1 << 20) // r.size)
    equal = np.concatenate([(q[i : i + rows, None, :] == r[None]).sum(axis=2) for i in range(0, len(q), rows)])
    at = equal.argmax(axis=1)
    at = at[equal[np.arange(len(q)), at] / q.shape[1] >= threshold].tolist()
    return len(at) / len(q), len(set(at)) / len(r), len(at), longest_run(at) / len(at) if at else 0.0


def null_model(archive: DataFrame, pairs: int = 384, seed: int = 13) -> DataFrame:
    """One row: mean and deviation of each channel's score over pairs of unrelated documents, drawn by hashed order.

    The archive's documents with the smallest hashes are paired; equal texts are left out. Bounded by ``pairs``.
    """
    chosen = archive.select("doc_id", "sha256").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(2 * pairs)
    ranked = chosen.withColumn("i", F.row_number().over(Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")))
    a = ranked.where("i % 2 = 1").select(F.col("doc_id").alias("q_id"), ((F.col("i") + 1) / 2).cast("int").alias("k"), F.col("sha256").alias("s"))
    b = ranked.where("i % 2 = 0").select(F.col("doc_id").alias("r_id"), (F.col("i") / 2).cast("int").alias("k"), "sha256")
    drawn = a.join(b, "k").where("s <> sha256").select("q_id", "r_id", F.lit(0).alias("exact"), F.lit(0).cast("bigint").alias("hits"))
    few = archive.join(F.broadcast(ranked.select("doc_id")), "doc_id", "left_semi")
    scored = channel_scores(drawn, few, few, small=True)
    return scored.agg(*[F.avg(f"ch_{c}").alias(f"mu_{c}") for c in sketch.WEIGHTS], *[F.coalesce(F.stddev_samp(f"ch_{c}"), F.lit(0.05)).alias(f"sd_{c}") for c in sketch.WEIGHTS])


def surprise(null: bool = True) -> Column:
    """Sum of the channels' deviations from the null model over the root of their number."""
    if not null:
        return F.lit(0.0)
    z = [F.coalesce((F.col(f"ch_{c}") - F.col(f"mu_{c}")) / F.greatest(F.col(f"sd_{c}"), F.lit(0.02)), F.lit(0.0)) for c in sketch.WEIGHTS]
    return sum(z[1:], z[0]) / F.sqrt(F.lit(float(len(z))))


def confidence(strength: Column, surprise: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength))
    bump = 1 - F.exp(-F.greatest(F.lit(0.0), surprise) / 6)
    return F.when(surprise <= 0, s).otherwise(F.least(F.lit(1.0), 0.65 * s + 0.35 * bump + 0.25 * s * bump))


def classify(rows: DataFrame, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """Adds relation and confidence. The conditions are tried in this order; the first that holds decides."""
    q, r = F.col("ch_word"), F.col("rev_word")
    strong = sum((F.when(F.col(f"ch_{c}") >= least, 1).otherwise(0) for c, least in (("rare", cfg.rare), ("num", cfg.num), ("char", cfg.char))), F.lit(0))
    ordered = (F.coalesce("order", F.lit(0.0)) >= cfg.order) | (F.coalesce("matched", F.lit(0)) <= 1)
    base = 0.5 * F.col("ch_rare") + 0.3 * F.col("ch_num") + 0.2 * F.col("ch_char")
    rules = (
        (F.col("same"), "identical", F.lit(None).cast("double")),
        ((q >= cfg.near_dup) & (r >= cfg.near_dup), "near_dup", F.least(q, r)),
        ((q >= cfg.excerpt) & (q - r >= cfg.gap), "contained_by", q),
        ((r >= cfg.excerpt) & (r - q >= cfg.gap), "contains", r),
        ((strong >= cfg.least_channels) & ordered, "derived", base),
    )
    relation, sure = F.lit("unrelated"), F.lit(0.0)
    for when, name, strength in reversed(rules):
        relation = F.when(when, name).otherwise(relation)
        sure = F.when(when, F.lit(1.0) if name == "identical" else confidence(strength, F.col("surprise"))).otherwise(sure)
    return rows.withColumn("relation", relation).withColumn("confidence", sure)


def ordered(found: DataFrame) -> DataFrame:
    """Matches with their place among those of a query, the surest first, ties by id."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("confidence"), "r_id")))


def oldest_time(archive: DataFrame) -> DataFrame:
    """One row: the earliest time and the number of dated documents of an archive."""
    return archive.agg(F.min("not_after").alias("oldest"), F.count("not_after").alias("n_dated"))


def matches(queries: DataFrame, archive: DataFrame, null: DataFrame | None = None, cfg: AlignConfig = AlignConfig(), wanted: Column | None = None, small: bool = False) -> DataFrame:
    """(q_id, r_id, relation, confidence, not_after, scores) of related pairs; both sides as of fingerprints, archive with not_after."""
    pairs = candidates(queries, archive, cfg, wanted=wanted)
    rows = _scored(_compared(pairs, queries, archive, True, small, cfg.window))
    rows = rows.join(F.broadcast(null)) if null is not None else rows
    rows = classify(rows.withColumn("surprise", surprise(null is not None)), cfg).where((F.col("relation") != "unrelated") & (F.col("confidence") >= cfg.confidence))
    return rows.join(archive.select(F.col("doc_id").alias("r_id"), "not_after"), "r_id")


def oldest_ancestor(found: DataFrame) -> DataFrame:
    """(doc_id, r_id, witness_time, confidence, relation): per query the earliest dated ancestral match, then the surest."""
    dated = found.where(F.col("relation").isin(*ANCESTRAL) & F.col("not_after").isNotNull())
    first = dated.groupBy(F.col("q_id").alias("doc_id")).agg(F.min(F.struct("not_after", (-F.col("confidence")).alias("c"), "r_id", "relation")).alias("m"))
    return first.select("doc_id", F.col("m.r_id").alias("r_id"), F.col("m.not_after").alias("witness_time"), (-F.col("m.c")).alias("confidence"), F.col("m.relation").alias("relation"))
