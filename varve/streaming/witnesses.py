"""Witnesses as a stream: repeated records dropped within a watermark, and a running bound per document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.witness import ConsensusConfig, independent

_STATE = "t array<timestamp>, op array<string>, f array<double>, slip array<double>, n array<bigint>"
_OUT = "doc_id string, not_after timestamp, log_p double, operators bigint, method string"


def deduped(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """One record per document, operator, kind, day and field, as far back as the watermark goes."""
    keys = ["doc_id", "operator", "kind", "day", "field"]
    return stream.withColumn("day", F.to_date("observed_at")).withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, width: str = "7 days", delay: str = "30 days") -> DataFrame:
    """Witnesses per operator and window of event time."""
    return stream.withWatermark("observed_at", delay).groupBy(F.window("observed_at", width), "operator").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "operator", "n")


def earliest_bound(rows: dict[tuple, list], cfg: ConsensusConfig) -> tuple:
    """(time, log_p, operators, method) of {(t, operator): [min forgeability, sum of log slips, n]}."""
    by_op: dict[str, list] = {}
    log_q: dict[str, float] = {}
    last = None
    times = sorted({t for t, _ in rows})
    at: dict[Any, list] = {}
    for (t, op), v in rows.items():
        at.setdefault(t, []).append((op, v))
    for t in times:
        for op, (f, slip, _n) in at[t]:
            held = by_op.setdefault(op, [1.0, 0.0])
            held[0], held[1] = min(held[0], f), held[1] + slip
            log_q[op] = math.log(max(1e-300, min(1.0, held[0] + (1 - held[0]) * math.exp(held[1]))))
        last = (t, sum(log_q.values()), len(log_q))
        if last[1] <= math.log(cfg.alpha) + 1e-12:
            return (*last, "weighted-order-statistic")
    return (*last, "best-effort-below-alpha")


def running_bounds(stream: DataFrame, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Each document's bound after every micro-batch that brings it evidence; state holds a row per time and operator."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows: dict[tuple, list] = {}
        if state.exists:
            for t, op, f, slip, n in zip(*state.get):
                rows[pd.Timestamp(t), op] = [f, slip, n]
        for batch in batches:
            for r in batch.itertuples():
                slot = rows.setdefault((r.observed_at, r.operator), [1.0, 0.0, 0])
                slot[0] = min(slot[0], r.forgeability)
                slot[1] += math.log(max(1e-9, 1 - r.reliability))
                slot[2] += 1
        state.update(([k[0].to_pydatetime() for k in rows], [k[1] for k in rows], [v[0] for v in rows.values()], [v[1] for v in rows.values()], [v[2] for v in rows.values()]))
        t, log_p, ops, method = earliest_bound(rows, cfg)
        yield pd.DataFrame({"doc_id": [str(key[0])], "not_after": [t], "log_p": [log_p], "operators": [ops], "method": [method]})

    used = stream.where(independent()).select(F.col("doc_id").cast("string").alias("doc_id"), "operator", "observed_at", "reliability", "forgeability")
    return used.groupBy("doc_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
