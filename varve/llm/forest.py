"""Candidate pairs from sorted signature orders, and exact confirmation of links between word-shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, give_back, jaccard_at_least, keep, local_forest, split_by_bytes

#: A path is LEVELS bytes in a long, the first level uppermost.
LEVELS = 8


def _near(tree, path, ids, n, lo: int, window: int, depth: int, percent: int, pos=None):
    """Pairs (i, j), i < j <= i + window and j >= lo, whose paths share ``depth`` levels and whose set sizes allow ``percent``.

    ``pos`` is the place of each row in its region; beyond ``window`` only the next neighbour is paired.
    """
    top, out = path >> np.int64(64 - 8 * depth) if depth < LEVELS else path, []
    for s in range(1, window + 1):
        j = np.arange(max(s, lo), len(ids))
        i = j - s
        same = (top[i] == top[j]) & (tree[i] == tree[j])
        if pos is not None and s > 1:
            same &= pos[j] <= window
        out.append(_fit(ids, n, i, j, same, percent))
    return out


def _fit(ids, n, i, j, same, percent: int):
    ok = same & (ids[i] != ids[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    return np.minimum(ids[i][ok], ids[j][ok]), np.maximum(ids[i][ok], ids[j][ok])


def _batch(pairs, edge=None) -> pa.RecordBatch:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
    ab = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    cols = {"a": ab[:, 0], "b": ab[:, 1], "gap": np.full(len(ab), -1), "tree": np.zeros(len(ab)), "path": np.zeros(len(ab)), "n": np.zeros(len(ab))}
    if edge is not None:
        gap, (tree, path, ids, n) = edge
        more = {"a": ids, "b": ids, "gap": np.full(len(ids), gap), "tree": tree, "path": path, "n": n}
        cols = {k: np.concatenate((v, more[k])) for k, v in cols.items()}
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in cols.values()], list(cols))


_SCHEMA = "a bigint, b bigint, gap bigint, tree bigint, path bigint, n bigint"


def forest_pairs(rows: DataFrame, depth: int, window: int, percent: int, parts: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of ``rows`` (tree, path, id, n), which must be a written table.

    In each tree's sorted order, rows that share at least ``depth`` levels form a region. The first ``window`` + 1 rows of a
    region are paired with each other, which is all of most regions. Where a region is denser, depth adapts: sorted
    neighbours there share the most levels of all, and each further row is paired with its nearest neighbour, with the first
    row of the region and with the first that shares its whole path. So a region of any size gives pairs in proportion to
    its rows, all of them connected, and every tree sorts it anew; ``dense_links`` finds the links these pairs leave out. The
    order is range-partitioned, also within a region and within equal paths; the neighbours on both sides of a cut are paired
    in a second small pass.
    """
    keys = ["tree", "path", "id"]
    ordered = rows.select(*keys, "n").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gap, last, first_rows, seen = TaskContext.get().partitionId(), None, None, 0
        leaders: dict[int, tuple] = {}
        for batch in batches:
            got = [batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "path", "id", "n")]
            if not len(got[0]):
                continue
            lo, here = 0 if last is None else len(last[0]), seen + np.arange(len(got[0]))
            extra, region = [], None
            for d in (depth, LEVELS) if depth < LEVELS else (LEVELS,):
                top = got[1] >> np.int64(64 - 8 * d) if d < LEVELS else got[1]
                fresh = np.ones(len(top), bool)
                fresh[1:] = (top[1:] != top[:-1]) | (got[0][1:] != got[0][:-1])
                lead = leaders.get(d)
                if lead is not None and lead[:2] == (got[0][0], top[0]):
                    fresh[0] = False
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(top)), -1))
                mine = start >= 0
                lead_id, lead_n, lead_at = (np.where(mine, column[start], old) for column, old in zip((got[2], got[3], here), lead[2:] if lead else (-1, 0, 0)))
                region = here - lead_at if region is None else region
                j = np.flatnonzero((here - lead_at > window) & (lead_id != got[2]) & (100 * np.minimum(lead_n, got[3]) >= percent * np.maximum(lead_n, got[3])))
                extra.append((np.minimum(lead_id[j], got[2][j]), np.maximum(lead_id[j], got[2][j])))
                leaders[d] = (got[0][-1], top[-1], int(lead_id[-1]), int(lead_n[-1]), int(lead_at[-1]))
            seen += len(got[0])
            got.append(region)
            tree, path, ids, n, pos = got if last is None else [np.concatenate(x) for x in zip(last, got)]
            pairs = _near(tree, path, ids, n, lo, window, depth, percent, pos) + extra
            if first_rows is None:
                first_rows = [x[:window] for x in got[:4]]
                yield _batch(pairs, (gap, first_rows))
            else:
                yield _batch(pairs)
            last = [x[-window:] for x in (tree, path, ids, n, pos)]
        if last is not None:
            yield _batch([], (gap + 1, last[:4]))

    found = keep(ordered.mapInArrow(scan, _SCHEMA))

    def stitch(table: pa.Table) -> pa.Table:
        got = [table.column(c).to_numpy() for c in ("tree", "path", "a", "n")]
        order = np.lexsort((got[2], got[1], got[0]))
        return pa.Table.from_batches([_batch(_near(*[x[order] for x in got], 0, window, depth, percent))])

    cuts = found.where("gap >= 0").groupBy("gap").applyInArrow(stitch, _SCHEMA)
    return found.where("gap < 0").select("a", "b").unionByName(cuts.select("a", "b")).distinct()


#: Pairs and ids up to so many are sent to every executor; beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def confirmed(pairs: DataFrame, rows: DataFrame, make: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose sets reach ``percent``; sets are made of rows (key, text) by ``make``.

    Each text's set is made where the text is read, once per side, and only that of b is shuffled with its pair.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch):
                keep_columns = [c for c in part.schema.names if c != "text"]
                sets = pa.array([x.tobytes() for x in make(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep_columns), sets], [*keep_columns, "set"])
        give_back()

    later = rows.join(_sent(pairs.select(F.col("b").alias("key"), "a")), "key").mapInArrow(made, "key bigint, a bigint, set binary").select(F.col("key").alias("b"), "a", F.col("set").alias("y"))
    firsts = _sent(keep(pairs.select(F.col("a").alias("key")).distinct()))
    first = rows.join(firsts, "key", "left_semi").select("key", "text").mapInArrow(made, "key bigint, set binary").select(F.col("key").alias("a"), F.col("set").alias("x"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard_at_least(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            chosen = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], ["a", "b"])

    return later.join(first, "a").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def linked_components(candidates: DataFrame, rows: DataFrame, make: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """(node, component) of the links that ``confirmed`` finds among ``candidates`` (a written table of distinct pairs).

    First each document is held against its smallest candidate. Pairs whose ends are linked by then need no confirmation,
    since only components are asked for; all others are confirmed in a second round.
    """
    first = keep(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = keep(confirmed(first, rows, make, percent).distinct())
    comp = keep(components(links))
    rest = candidates.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    rest = keep(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    if rest.isEmpty():
        return comp
    more = keep(confirmed(rest, rows, make, percent).distinct())
    return keep(components(links.unionByName(more)))


#: Rows of a dense region that are compared in one task at a time, on either side, and shingles counted at a time.
BLOCK, COLUMNS = 512, 4096
#: Trees whose dense regions are searched together; components are brought up to date in between.
ROUNDS = (2, 6)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)) sizes of the intersections of sets without repeats."""
    out = np.zeros((len(x), len(y)), np.float32)
    flat = np.concatenate([*x, *y]) if x or y else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    place = np.cumsum(np.concatenate(([0], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
    # a shingle counts only where both sides have it
    both = (np.bincount(place, row < len(x)) > 0) & (np.bincount(place, row >= len(x)) > 0) if len(flat) else np.empty(0, bool)
    used = both[place]
    place, row = (np.cumsum(both) - 1)[place[used]], row[used]
    for lo in range(0, int(both.sum()), COLUMNS):
        s, e = np.searchsorted(place, (lo, lo + COLUMNS))
        has = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        has[row[s:e], place[s:e] - lo] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out.astype(np.int64)


def dense_links(inside: DataFrame, comp: DataFrame, rows: DataFrame, make: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """(a, b) links that join, within components, all rows linked in a region of ``inside`` (tree, top, id) but not yet in ``comp``.

    Where a region's rows are in more than one component, every pair of rows of different components is compared on the full
    sets, blocks of BLOCK rows on either side at a time; pairs within the largest component are not dealt at all. Links,
    not pairs, leave a task.
    """
    inside = inside.join(comp.withColumnRenamed("node", "id"), "id", "left").select("tree", "top", "id", F.coalesce("component", "id").alias("c"))
    sizes = inside.groupBy("tree", "top", "c").agg(F.count("*").alias("m")).groupBy("tree", "top").agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    mixed = keep(sizes.where("lo <> hi").select("tree", "top", F.col("most.c").alias("most"), blocks(F.col("most.m")).alias("big"), blocks(F.col("m") - F.col("most.m")).alias("rest")))
    if mixed.isEmpty():
        forget(mixed)
        return comp.sparkSession.createDataFrame([], "a bigint, b bigint")
    # blocks of the largest component come first, and are held against the blocks of the others only
    dealt = inside.join(_sent(mixed), ["tree", "top"])
    hashed = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("c") == F.col("most"), hashed("big")).otherwise(F.col("big") + hashed("rest")))
    last = F.col("big") + F.col("rest") - 1
    right = F.transform(F.sequence(F.greatest("block", "big"), last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(False).alias("second")))
    left = F.when((F.col("block") >= F.col("big")) & (F.col("block") > 0), F.transform(F.sequence(F.lit(0), F.col("block") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("second"))))
    empty = F.array().cast("array<struct<i:int,j:int,second:boolean>>")
    dealt = keep(dealt.select("tree", "top", "id", "c", F.explode(F.concat(right, F.coalesce(left, empty))).alias("p")).select("tree", "top", "id", "c", "p.*"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([x.tobytes() for x in make(part.column("text"))], pa.binary())], ["id", "set"])
        give_back()

    ids = _sent(keep(dealt.select(F.col("id").alias("key")).distinct()))
    sets = keep(rows.join(ids, "key", "left_semi").select("key", "text").mapInArrow(made, "id bigint, set binary").dropDuplicates(["id"]))

    def compare(table: pa.Table) -> pa.Table:
        ids, c = (table.column(k).to_numpy() for k in ("id", "c"))
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        x = [np.frombuffer(v.as_buffer(), np.uint64) for chunk in table.column("set").chunks for v in chunk]
        n = np.array([len(v) for v in x])
        p = np.flatnonzero(~second)
        q = np.flatnonzero(second) if second.any() else p
        ea, eb = [], []
        for s in range(0, len(p), BLOCK):
            for t in range(0, len(q), BLOCK):
                i, j = p[s : s + BLOCK], q[t : t + BLOCK]
                if not (c[i][:, None] != c[j][None]).any():
                    continue
                both = common_counts([x[k] for k in i], [x[k] for k in j])
                hit = (c[i][:, None] != c[j][None]) & (100 * both >= percent * (n[i][:, None] + n[j][None] - both)) & (both > 0)
                u, v = np.nonzero(hit)
                ea.append(i[u]), eb.append(j[v])
        a, b = local_forest(np.concatenate(ea), np.concatenate(eb), len(ids)) if ea else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    links = keep(dealt.join(sets, "id").select("tree", "top", "i", "j", "id", "c", "second", "set").groupBy("tree", "top", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct())
    forget(mixed, dealt, sets)
    return links


def forest_components(entries: DataFrame, comp: DataFrame, rows: DataFrame, make: Callable[[pa.Array], list[np.ndarray]], depth: int, window: int, percent: int, trees: int) -> DataFrame:
    """``comp`` (node, component), joined further by the links within the dense regions of ``entries``, a few trees at a time.

    A region is dense if it has more rows than ``forest_pairs`` pairs with each other.
    """
    at = entries.withColumn("top", F.shiftright("path", 64 - 8 * depth) if depth < LEVELS else F.col("path")).select("tree", "top", "id")
    dense = keep(at.groupBy("tree", "top").agg(F.count("*").alias("m")).where(F.col("m") > window + 1).select("tree", "top"))
    inside = keep(at.join(_sent(dense), ["tree", "top"]))
    for lo, hi in zip((0, *ROUNDS), (*ROUNDS, trees)):
        links = dense_links(inside.where((F.col("tree") >= lo) & (F.col("tree") < hi)), comp, rows, make, percent)
        if not links.isEmpty():
            comp = keep(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))
    forget(dense, inside)
    return comp
