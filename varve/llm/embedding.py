"""Near-duplicate vectors: product quantisation in coarse inverted lists, then exact cosine.

The index (coarse centroids and residual codebooks) is fitted on a bounded sample; every vector is indexed. For a link at
cosine t, unit vectors are within r = sqrt(2 - 2 t). Two such vectors are in different lists only if the first is within r
of the plane between the centroids, so a vector probes every list whose plane is that near, which is every list it can
link to. A code is passed over only if its table-lookup distance exceeds r plus the vector's own
quantisation error, which loses nothing. Of two lists the one with the smaller number asks, and a link counts for both ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep, local_forest

#: Vectors of a list that are compared in one task at a time, on either side.
BLOCK = 512
SLACK = 1e-6
#: Numbers in a sample that an index is fitted on.
SAMPLE_VALUES = 4_000_000


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(at, x[:, j], k)
            c[n > 0, j] = s[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, d)
    books: list[np.ndarray]  # per subspace (codes, width)
    cuts: list[tuple[int, int]]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the quantisation error) of unit vectors."""
        at = nearest(x, self.centroids)
        rest = x - self.centroids[at]
        codes = np.stack([nearest(rest[:, a:b], c) for (a, b), c in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([c[codes[:, m]] for m, c in enumerate(self.books)], axis=1)
        return at, codes, np.sqrt(((rest - back) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, at: np.ndarray, radius: float) -> np.ndarray:
        """(rows, lists) mask of the lists from a vector's own on that it probes for vectors within ``radius``."""
        d2 = (x**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
        own, reach = d2[np.arange(len(x)), at], radius + SLACK
        return (d2 - own[:, None] <= 2 * reach * self.gaps[at] + SLACK) & (np.arange(len(self.centroids)) >= at[:, None])

    @cached_property
    def gaps(self) -> np.ndarray:
        """(lists, lists) distances between centroids."""
        c2 = (self.centroids**2).sum(axis=1)
        return np.sqrt(np.maximum(0, c2[:, None] + c2 - 2 * self.centroids @ self.centroids.T))

    def table_distances(self, x: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """(queries, codes) distances by lookup in each query's tables for the list ``of``."""
        rest, total = x - self.centroids[of], np.zeros((len(x), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            part = rest[:, a:b]
            tables = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * part @ book.T
            total += tables[:, codes[:, m]]
        return np.sqrt(np.maximum(0, total))


def fit(sample: np.ndarray, lists: int, subspaces: int, codes: int = 256, seed: int = 5) -> Index:
    d = sample.shape[1]
    centroids = kmeans(sample, lists, 8, seed)
    rest = sample - centroids[nearest(sample, centroids)]
    edges = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return Index(centroids, [kmeans(rest[:, a:b], codes, 6, seed + 1 + k) for k, (a, b) in enumerate(cuts)], cuts)


def near_vectors(
    vectors: DataFrame, *, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample_rows: int = 8192, max_lists: int = 512, subspaces: int = 16, indexes: int = 16
) -> DataFrame:
    """Per row: key, n_links (other vectors linked directly), component_id (smallest key reachable, itself included), kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least ``cosine``
    (which must exceed 0). Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Equal vectors of a label form one class that is compared once and counted with its rows.
    Each of the ``indexes`` commonest lengths has an index fitted on at most ``sample_rows`` vectors (fewer where they are very
    long), with half as many lists as the root of its classes, up to ``max_lists``; other lengths are compared whole.
    Each repeated row counts as a vector; rows that share a key are one node of the components. Rows with a null key are kept,
    with null component, and link with nothing. Counts, not pairs, leave a task: blocks of at most BLOCK vectors of a list on
    either side are compared at a time, so a list or label with a third of all rows is dealt over many tasks.
    """
    v = F.col("vec")
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    fine = F.coalesce(F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad & F.when(~bad, norm2 > 0), F.lit(False))
    # 0.0 and -0.0 are equal to a grouping, and to a cosine
    classes = keep(rows.where(fine).groupBy("label", "vec").agg(F.min("key").alias("rep"), F.count("*").alias("copies")))
    lengths = classes.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(indexes + 1).collect()
    if not lengths:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
    radius = float(np.sqrt(2 - 2 * cosine))

    placed = []
    for w, total in lengths[:indexes]:
        mine = classes.where(F.size("vec") == w)
        taken = mine.orderBy(F.xxhash64("rep", "label")).limit(max(1, min(sample_rows, SAMPLE_VALUES // w))).select("vec").collect()
        sample = np.array([r[0] for r in taken])
        sample = sample / np.abs(sample).max(axis=1)[:, None]
        index = fit(unit(sample), int(min(max_lists, max(1, np.sqrt(total) / 2))), subspaces)
        placed.append(_linked(mine, index, w, cosine, radius))
    if len(lengths) > indexes:
        placed.append(_linked(classes.where(~F.size("vec").isin([w for w, _ in lengths[:indexes]])), None, 0, cosine, radius))
    found = keep(reduce(DataFrame.unionByName, placed))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    edges = found.where("b is not null").select("a", "b")
    comp = keep(components(edges))
    node = comp.select(F.col("node").alias("rep"), "component")
    per_class = classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(node, "rep", "left")
    per_class = per_class.select("label", "vec", "rep", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.withColumn("at", F.when(fine, F.col("vec"))).join(per_class.withColumnRenamed("vec", "at"), ["label", "at"], "left")
    where = F.coalesce("component", "rep", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), where.alias("component_id"), F.coalesce(F.col("key") == where, F.lit(True)).alias("kept"))


def _linked(classes: DataFrame, index: Index | None, width: int, cosine: float, radius: float) -> DataFrame:
    """Rows (a, b, n): with b null, class a links to n vectors of other classes; else an edge that keeps the components.

    Without an index vectors of any length are taken, and all of a length are a list.
    """
    sent = classes.sparkSession.sparkContext.broadcast(index)
    label = classes.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = sent.value
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                if ix is None:
                    x = [np.array(v, np.float64) for v in part.column("vec").to_pylist()]
                    x = [v / np.abs(v).max() for v in x]
                    x = [v / np.sqrt(v @ v) for v in x]
                    at, codes, err = np.array([len(v) for v in x]), np.zeros((len(x), 0), np.uint8), np.zeros(len(x))
                    q, to = np.arange(len(x)), at
                else:
                    x = np.array(part.column("vec").to_pylist(), np.float64).reshape(-1, width)
                    x = x / np.abs(x).max(axis=1)[:, None]
                    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                    at, codes, err = ix.encode(x)
                    q, to = np.nonzero(ix.probes(x, at, radius))
                row = pa.array(np.concatenate((np.arange(len(x)), q)), pa.int64())
                vec = pa.array([v.tobytes() for v in x], pa.binary())
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                asks = np.concatenate((np.zeros(len(x), bool), np.ones(len(q), bool)))
                take = lambda name: part.column(name).take(row)
                yield pa.RecordBatch.from_arrays(
                    [take("label"), take("rep"), take("copies"), pa.array(np.concatenate((at, to)), pa.int64()), pa.array(np.concatenate((at, at[q])), pa.int64()), pa.array(asks), vec.take(row), code.take(row), pa.array(err).take(row)],
                    ["label", "rep", "copies", "list", "own", "asks", "vec", "code", "err"],
                )

    spread = keep(classes.select("label", "rep", "copies", "vec").mapInArrow(place, f"label {label}, rep bigint, copies bigint, list bigint, own bigint, asks boolean, vec binary, code binary, err double"))
    sizes = spread.groupBy("label", "list").agg((F.ceil(F.count_if(~F.col("asks")) / BLOCK)).cast("int").alias("blocks"), (F.ceil(F.count_if("asks") / BLOCK)).cast("int").alias("ask_blocks")).where("blocks > 0 and ask_blocks > 0")
    dealt = spread.join(sizes, ["label", "list"])
    mine = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(n)).cast("int")
    other = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = dealt.where("not asks").withColumn("i", mine("blocks")).withColumn("j", F.explode(other("ask_blocks")))
    asked = dealt.where("asks").withColumn("j", mine("ask_blocks")).withColumn("i", F.explode(other("blocks")))
    both = held.unionByName(asked).select("label", "list", "i", "j", "rep", "copies", "own", "asks", "vec", "code", "err")

    def compare(table: pa.Table) -> pa.Table:
        ix: Index = sent.value
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        rep, copies, err = (table.column(c).to_numpy() for c in ("rep", "copies", "err"))
        h, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(len(rep), -1)
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
        of, links, ea, eb = table.column("list")[0].as_py(), np.zeros(len(rep), np.int64), [], []
        cross = table.column("own").to_numpy() != of
        for s in range(0, len(q), 128):
            part = q[s : s + 128]
            near = ix.table_distances(vec[part], of, codes[h]) <= radius + err[h][None] + SLACK if ix is not None else np.ones((len(part), len(h)), bool)
            some = np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            hit = near[:, some] & (vec[part] @ vec[h[some]].T >= cosine) & (rep[part][:, None] != rep[h[some]][None])
            links[part] += hit @ copies[h[some]]
            links[h[some]] += hit.T @ (copies[part] * cross[part])
            i, j = np.nonzero(hit)
            if len(i):
                a, b = np.unique(np.stack([part[i], h[some][j]]), axis=1)
                ea.append(a), eb.append(b)
        n_rep, place_of = np.unique(rep, return_inverse=True)
        if ea:
            a, b = local_forest(place_of[np.concatenate(ea)], place_of[np.concatenate(eb)], len(n_rep))
        else:
            a = b = np.empty(0, np.int64)
        linked = links > 0
        return pa.table({
            "a": pa.array(np.concatenate((rep[linked], n_rep[a]))), "n": pa.array(np.concatenate((links[linked], np.zeros(len(a), np.int64)))),
            "b": pa.concat_arrays([pa.nulls(int(linked.sum()), pa.int64()), pa.array(n_rep[b], pa.int64())]),
        }).select(["a", "b", "n"])

    return both.groupBy("label", "list", "i", "j").applyInArrow(compare, "a bigint, b bigint, n bigint")
