"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, split_by_bytes

FEATURES = (
    "log_bytes", "log_words", "mean_word", "max_word", "upper", "digit", "symbol", "stop", "pipe", "space", "non_ascii", "entropy",
    "distinct_words", "top_word", "top_five_words", "same_as_next", "shouted_words", "symbol_words", "short_words", "long_words",
    "words_per_line", "repeated_lines", "compression", "distinct_pairs", "bangs", "braces",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SPACE = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(b"0123456789"), _mask(b" \t\r\n")
_SYMBOL, _STOP, _BRACE = _mask(b"#$%&*+=@^_~\\`<>"), _mask(b".,;:?"), _mask(b"{}[]()<>")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; of an empty one, zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words, lines, n = text.split(), text.split("\n"), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    part = lambda mask: float(counts[mask].sum()) / n
    m, seen = max(1, len(words)), Counter(words)
    common, sizes = [c for _, c in seen.most_common(5)] or [0], list(map(len, words)) or [0]
    many = list(seen.items())
    return [
        np.log1p(n), np.log1p(len(words)), sum(sizes) / m, float(min(max(sizes), 200)), part(_UPPER), part(_DIGIT), part(_SYMBOL), part(_STOP),
        counts[ord("|")] / n, part(_SPACE), float(counts[128:].sum()) / n, float(-(share * np.log2(share)).sum()),
        len(seen) / m, common[0] / m, sum(common) / m, sum(map(eq, words, words[1:])) / m,
        sum(c for w, c in many if w.isupper() and len(w) > 1) / m, sum(c for w, c in many if not w[-1].isalnum() and w[-1] not in ".,;:?\"')") / m,
        sum(s <= 2 for s in sizes) / m, sum(s >= 14 for s in sizes) / m,
        m / len(lines), 1 - len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / n, len(set(zip(words, words[1:]))) / m,
        counts[ord("!")] / n, part(_BRACE),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth in arrays: node i of a level has children 2i + 1 and 2i + 2; x > threshold goes right."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic boosting; splits between at most ``bins`` quantile bins of each feature, by sums of gradients in histograms.

    Without rows or with one class only, the score is a constant (the smoothed share of class 1).
    """
    base = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(base))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * bins
    margin, made = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (d * bins) + flat).ravel()
            sums = [np.bincount(slot, np.repeat(v, d), width * d * bins).reshape(width, d, bins) for v in (g, h)]
            left = [s.cumsum(axis=2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            right = [w - s for w, s in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[1] < least * 0.05) | (right[1] < least * 0.05)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                if gain[k].reshape(-1)[b] > 1e-9:
                    feature[first + k], threshold[first + k] = b // bins, edges[b // bins][b % bins]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        at -= inner
        leaf = np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2) * rate
        margin += leaf[at]
        made.append((feature, threshold, leaf))
    return Trees(*(np.array(v) for v in zip(*made)), float(base))


def is_held_out(key, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def _features(rows: DataFrame) -> DataFrame:
    """(key, others, features) by Arrow batches."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(values, pa.list_(pa.float64()))], [*others, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **options) -> Trees:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold, the first by a hash of their id.

    A document labelled twice counts once, with its larger label; null ids and labels are left out.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~is_held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(rows), "key")
    # one row a document, however often it is repeated
    found = _features(joined).groupBy("key", "y").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: (str(r.key), r.x))
    return fit(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.y for r in found], float), **options)


def score(docs: DataFrame, model: Trees, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, columns: list[str] = ()) -> DataFrame:
    """Per row: key, held_out, score (0 to 1; higher: label 1 likelier), predicted (1 if score >= threshold), others.

    A null text is scored as an empty one. Only the text is an input of the score. Repeated rows each keep a row. ``others`` is a
    struct of ``columns`` under their own names, so they clash with no column of the result; it is absent if none are asked for.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    carried = [F.struct(*[F.col(c) for c in columns]).alias("others")] if columns else []
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *carried)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch):
                x = np.array([statistics(v.as_py()) for v in part.column("text")]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(sent.value.score(x))], [*others, "score"])
        give_back()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    out = rows.mapInArrow(run, f"{kinds}, score double")
    held = F.coalesce(is_held_out("key"), F.lit(False))
    return out.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["others"] if columns else []))
