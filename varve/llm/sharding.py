"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a 64-bit key: its upper half is a hash of the text, its lower half one of the id, so equal
texts are neighbours and yet a group of copies can be cut anywhere. Exact bytes and rows below candidate
boundaries are counted over all partitions; only ranges that hold a splitter out of tolerance, or too many rows, are
probed again with finer boundaries. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, literal_rows

#: Bits of the key resolved after each round of probes.
DEPTHS = (12, 20, 28, 36, 44, 52, 60)


def _leaves(base: DataFrame, shards: int, tolerance: float) -> list[tuple]:
    """Ranges of keys in order: (depth, prefix, rows, bytes).

    Bounded whatever the input: 4096 ranges at first; a range is split in 256 only if it holds one of the
    ``shards - 1`` splitters out of tolerance or over 1/1024 of all rows, so at most shards + 1024 of them a round.
    """
    prefix = lambda d: F.shiftrightunsigned("order", 64 - d)
    count = (F.count("*"), F.sum("size"))
    found = [(12, r[0], r[1], r[2]) for r in base.groupBy(prefix(12).alias("p")).agg(*count).collect()]
    rows, total = sum(x[2] for x in found), sum(x[3] for x in found)
    for depth, finer in zip(DEPTHS, DEPTHS[1:]):
        found.sort(key=lambda x: x[1] << (64 - x[0]))
        below, again = 0, set()
        for d, p, n, size in found:
            inside = [k for k in range(1, shards) if below < total * k / shards < below + size and min(total * k / shards - below, below + size - total * k / shards) > tolerance * total / shards]
            below += size
            if d == depth and n > 1 and (inside or n > max(1024, rows / 1024)):
                again.add(p)
        if not again:
            break
        probed = literal_rows(base.sparkSession, [(p,) for p in sorted(again)], "p bigint")
        finer_rows = base.withColumn("p", prefix(depth)).join(F.broadcast(probed), "p", "left_semi").groupBy(prefix(finer).alias("p")).agg(*count).collect()
        found = [x for x in found if (x[0], x[1]) not in {(depth, p) for p in again}] + [(finer, r[0], r[1], r[2]) for r in finer_rows]
    return sorted(found, key=lambda x: x[1] << (64 - x[0]))


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, shard, slot, order.

    Law ``bytes``: the shards' sizes differ from the mean by ``tolerance`` of it, or by one row where rows are larger than
    that. Rows with equal texts follow each other and share a shard unless they straddle a splitter that can't
    keep its tolerance otherwise. Slots count from 0 without gaps in key order. Repeated rows each get a slot; a null text counts
    as empty; a null id hashes as null. An empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    high, low = F.xxhash64(content.cast("binary")), F.xxhash64(F.col(key), F.lit(11))
    base = keep(docs.select(
        F.col(key).alias("key"), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
        F.shiftleft(F.shiftrightunsigned(high, 32), 32).bitwiseOR(F.shiftrightunsigned(low, 32)).alias("order"),
    ))
    leaves = _leaves(base, shards, tolerance)
    total, below, slots, plan = sum(x[3] for x in leaves), 0, {}, []
    for depth, p, n, size in leaves:
        to = min(shards - 1, int((below + size / 2) * shards / total))
        plan.append((depth, p, to, slots.get(to, 0)))
        slots[to] = slots.get(to, 0) + n
        below += size
    table = literal_rows(docs.sparkSession, plan, "depth int, prefix bigint, shard int, first bigint")
    out = base
    depths = sorted({x[0] for x in plan})
    for d in depths:
        part = F.broadcast(table.where(F.col("depth") == d).select(F.col("prefix").alias(f"p{d}"), F.struct("shard", "first", "depth", "prefix").alias(f"leaf{d}")))
        out = out.withColumn(f"p{d}", F.shiftrightunsigned("order", 64 - d)).join(part, f"p{d}", "left")
    leaf = F.coalesce(*[F.col(f"leaf{d}") for d in depths]) if depths else F.lit(None).cast("struct<shard:int,first:bigint,depth:int,prefix:bigint>")
    out = out.select("key", "size", "text_crc32", "order", leaf.alias("leaf"))
    in_leaf = F.row_number().over(Window.partitionBy("leaf.depth", "leaf.prefix").orderBy(F.col("order").bitwiseXOR(F.lit(-(2**63))), "key", "size", "text_crc32"))
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.col("leaf.shard").alias("shard"), (F.col("leaf.first") + in_leaf - 1).alias("slot"), "order")
