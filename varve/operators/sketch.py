"""Shingles, windows, MinHash and SimHash channels of normalised documents, and scores between their sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (fixed values)
SLOTS, WINDOW_SLOTS, WORD, CHAR, WINDOW, STRIDE, PRIME = 128, 64, 5, 5, 128, 64, 2147483647
WEIGHTS = {"word": 0.40, "char": 0.25, "rare": 0.25, "num": 0.10}


def coefficients(count: int, seed: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the permutations, from a linear congruential sequence."""
    x, out = seed, []
    for _ in range(2 * count):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(1 + x % (PRIME - 1))
    return out[:count], out[count:]


def word_shingles(words: Column, width: int = WORD) -> Column:
    """Runs of ``width`` words; a shorter text is one shingle, an empty one none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(runs)


def char_shingles(flat: Column, width: int = CHAR) -> Column:
    """Runs of ``width`` characters of the text without spaces. The characters are bound once, not split again for each run."""
    chars = F.split(F.replace(flat, F.lit(" "), F.lit("")), "")
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(c, i, width), ""))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.get(F.transform(F.array(chars), runs), F.lit(0)))


def hash28(item: Column) -> Column:
    """28 bits of MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(item), 1, 7), 16, 10).cast("bigint")


def hash60(item: Column) -> Column:
    return F.conv(F.substring(F.md5(item), 1, 15), 16, 10).cast("bigint")


def windows(words: Column, size: int = WINDOW, stride: int = STRIDE) -> Column:
    """array of (idx, start, end): strided windows and one more that ends with the text."""
    n = F.size(words)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), n - size, F.lit(stride)), F.array(n - size)))
    made = F.transform(starts, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), F.least(n, s + size).alias("end")))
    return F.when(n == 0, F.array().cast("array<struct<idx:int,start:int,end:int>>")).otherwise(made)


def minhash(df: DataFrame, hashes: str, into: str, slots: int = SLOTS, seed: int = 1) -> DataFrame:
    """Adds the signature array ``into`` of the array of 28-bit hashes: min of (a * h + b) mod PRIME; PRIME everywhere for none.

    Arrow batches; numpy minima over segments. ``minhash_sql`` is the same in expressions.
    """
    a, b = (np.array(x, np.int64) for x in coefficients(slots, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                column = part.column(hashes)
                flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
                n = np.where(column.is_valid().to_numpy(zero_copy_only=False), n, 0)
                out = np.full((len(n), slots), PRIME, np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    for j in range(slots):
                        out[some, j] = np.minimum.reduceat((flat * a[j] + b[j]) % PRIME, starts)
                offsets = pa.array(np.arange(len(n) + 1) * slots, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*part.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{into}` array<bigint>")


def minhash_sql(hashes: Column, slots: int = SLOTS, seed: int = 1) -> Column:
    long = lambda x: F.lit(x).cast("bigint")

    def slot(a: int, b: int) -> Column:
        return F.coalesce(F.array_min(F.transform(hashes, lambda h: (h * long(a) + long(b)) % long(PRIME))), long(PRIME))

    return F.array(*[slot(a, b) for a, b in zip(*coefficients(slots, seed))])


def simhash(items: DataFrame, bits: int = 60) -> DataFrame:
    """(doc_id, simhash) of rows (doc_id, item): signs of sums over bits, each distinct item weighing c / log2(1 + c), c its count.

    Weights are whole millionths, so sums don't depend on their order.
    """
    counted = items.groupBy("doc_id", "item").agg(F.count("*").alias("c"))
    weight = F.round(F.col("c") / F.log2(1 + F.col("c")) * 1_000_000).cast("bigint")
    rows = counted.select("doc_id", hash60(F.col("item")).alias("h"), weight.alias("w"))
    sums = rows.groupBy("doc_id").agg(*[F.sum(F.when(F.shiftright("h", i).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"b{i}") for i in range(bits)])
    mark = F.lit(0).cast("bigint")
    for i in range(bits):
        mark = mark + F.when(F.col(f"b{i}") > 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return sums.select("doc_id", mark.alias("simhash"))


def _least(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """Row for each range of ``flat``: min of (a * h + b) mod PRIME for each slot; PRIME for empty ranges. Ranges may overlap."""
    a, b = (np.array(x, np.uint64) for x in coefficients(slots, seed))
    out = np.full((len(starts), slots), PRIME, np.int32)
    some = np.flatnonzero(ends > starts)
    if not len(some):
        return out
    # reduceat takes the minimum from each bound to the next; every second one is that of a range
    bounds, flat, p = np.column_stack((starts[some], ends[some])).ravel(), np.append(flat, 0).astype(np.uint64), np.uint64(PRIME)
    for j in range(slots):
        h = flat * a[j] + b[j]
        for _ in range(2):
            h = (h & p) + (h >> np.uint64(31))
        out[some, j] = np.minimum.reduceat(np.where(h >= p, h - p, h), bounds)[::2]
    return out


def _char_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number for each text) of the distinct character shingles of texts without spaces; each is hashed once a batch."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    whole = [k for k, x in enumerate(codes) if 0 < len(x) < CHAR or len(x) and x.max() >= 1 << 12]
    plain = [k for k, x in enumerate(codes) if len(x) >= CHAR and x.max() < 1 << 12]
    found, count = [np.empty(0, np.int64)] * len(texts), np.zeros(len(texts), np.int64)
    md5 = lambda x: int(hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)
    for k in whole:
        found[k] = np.array([md5(x) for x in {texts[k][i : i + CHAR] for i in range(max(1, len(texts[k]) - CHAR + 1))}], np.int64)
    if plain:
        keys = []
        for k in plain:
            x = codes[k].astype(np.uint64)
            n = len(x) - CHAR + 1
            keys.append(np.unique(sum((x[i : i + n] << np.uint64(12 * i) for i in range(1, CHAR)), x[:n].copy())))
        each, at = np.unique(np.concatenate(keys), return_inverse=True)
        chars = ((each[:, None] >> np.arange(0, 12 * CHAR, 12, dtype=np.uint64)) & np.uint64(4095)).astype(np.uint32)
        joined = chars.tobytes().decode("utf-32-le", "surrogatepass")
        hashes = np.fromiter((md5(joined[i : i + CHAR]) for i in range(0, len(joined), CHAR)), np.int64, len(each))[at]
        for k, part in zip(plain, np.split(hashes, np.cumsum([len(x) for x in keys])[:-1])):
            found[k] = part
    for k, x in enumerate(found):
        count[k] = len(x)
    return np.concatenate(found) if found else np.empty(0, np.int64), count


def _window_ranges(n_words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number for each document) of the windows in the list of all word shingles; documents begin at ``at``."""
    starts, ends = [], []
    for n, first in zip(n_words.tolist(), at.tolist()):
        own = [] if not n else [0] if n <= WINDOW else list(range(0, n - WINDOW + 1, STRIDE))
        if n > WINDOW and own[-1] != n - WINDOW:
            own.append(n - WINDOW)
        starts.append(first + np.array(own, np.int64))
        ends.append(first + np.array([max(s + 1, min(n, s + WINDOW) - WORD + 1) for s in own], np.int64))
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(starts), cat(ends), np.array([len(x) for x in starts], np.int64)


def fingerprints(normalised: DataFrame, tokens: bool = True) -> DataFrame:
    """(doc_id, sha256, n_tokens, tokens, n_<channel>, m_<channel>, w) per document: cardinality and signature of each channel, and
    ``w``, the sketches of all windows one after the other. ``tokens`` may be left out.

    A window's shingles are a range of those of its document, so each word shingle is hashed once; character shingles are hashed
    once a batch.
    """
    rows = normalised.select("doc_id", "sha256", "tokens", "flat", word_shingles(F.col("tokens")).alias("s"), F.array_distinct("rare_terms").alias("rare"), F.array_union("numerals", F.transform("entities", F.lower)).alias("num"))
    rows = rows.select(
        "doc_id", "sha256", F.size("tokens").alias("n_tokens"), *(["tokens"] if tokens else []), F.size(F.array_distinct("s")).alias("n_word"), F.replace("flat", F.lit(" "), F.lit("")).alias("flat"),
        *[F.transform(x, hash28).alias(f"h_{c}") for c, x in (("word", F.col("s")), ("rare", F.col("rare")), ("num", F.col("num")))],
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sent = ["doc_id", "sha256", "n_tokens", *(["tokens"] if tokens else [])]
    names = [*sent, *[f"n_{c}" for c in WEIGHTS], *[f"m_{c}" for c in WEIGHTS], "w"]

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.ravel(), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                number, signs, windows = {}, {}, None
                for c in WEIGHTS:
                    if c == "char":
                        flat, n = _char_hashes([t or "" for t in part.column("flat").to_pylist()])
                    else:
                        flat, n = part.column(f"h_{c}").flatten().to_numpy(zero_copy_only=False), np.diff(part.column(f"h_{c}").offsets.to_numpy())
                    at = np.concatenate(([0], np.cumsum(n)))
                    signs[c] = lists(_least(flat, at[:-1], at[1:], SLOTS, 1), np.full(len(n), SLOTS))
                    number[c] = part.column("n_word") if c == "word" else pa.array(n, pa.int32())
                    if c == "word":
                        starts, ends, many = _window_ranges(part.column("n_tokens").to_numpy(zero_copy_only=False), at[:-1])
                        windows = lists(_least(flat, starts, ends, WINDOW_SLOTS, 2), many * WINDOW_SLOTS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in sent), *number.values(), *signs.values(), windows], names)

    schema = ", ".join(f"{c} {kinds.get(c, 'int' if c[:2] == 'n_' else 'array<int>')}" for c in names)
    return rows.mapInArrow(run, schema)


def window_sketches(prints: DataFrame, slots: int = WINDOW_SLOTS) -> DataFrame:
    """(doc_id, idx, start, end, minhash), one row per window."""
    at = prints.select("doc_id", "tokens", F.explode(windows(F.col("tokens"))).alias("w"))
    piece = F.slice("tokens", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    rows = at.select("doc_id", F.col("w.idx").alias("idx"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.transform(F.array_distinct(word_shingles(piece)), hash28).alias("h"))
    return minhash(rows, "h", "minhash", slots, seed=2).drop("h")


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def containment(j: Column, size_a: Column, size_b: Column) -> Column:
    """Estimated share of a in b."""
    common = j * (size_a + size_b) / (1 + j)
    return F.when((size_a > 0) & (size_b > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), common / size_a))).otherwise(0.0)


def simhash_similarity(a: Column, b: Column, bits: int = 60) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / bits


def combined(scores: dict[str, Column]) -> Column:
    return sum((scores[c] * w for c, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
