"""Propagation along a derivation graph: no document is cleaner than its sources allow."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (fixed values)
DERIVED, CITED, ROUNDS, TOLERANCE = 0.92, 0.25, 32, 1e-6


def attenuation(kind: str = "kind", weight: str = "weight") -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(weight))) * F.when(F.col(kind) == "derived", DERIVED).otherwise(CITED)


def propagate(scores: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, p, p_direct) of scores (doc_id, p) under edges (src, dst, kind, weight).

    With c = 1 - p, an edge lets c(dst) be no less than w * c(src). Only documents that changed in a round send
    again, so a round costs what is still moving. Attenuation is at most .92, so changes die out, also on cycles;
    edges with an end outside ``scores`` are left out. Rounds are cut by checkpoint(), in the shared folder.
    """
    spark = scores.sparkSession
    _ensure_checkpoints(spark)
    known = scores.select("doc_id")
    e = edges.select("src", "dst", attenuation().alias("w"))
    e = e.join(known.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(known.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.max("w").alias("w")).checkpoint()
    state = scores.select("doc_id", (1 - F.col("p")).alias("c0"), (1 - F.col("p")).alias("c")).checkpoint()
    moved = state.select("doc_id", "c")
    for _ in range(rounds):
        sent = moved.join(e, moved["doc_id"] == e["src"]).groupBy("dst").agg(F.max(F.col("w") * F.col("c")).alias("got"))
        joined = state.join(sent, state["doc_id"] == sent["dst"], "left")
        state = joined.select("doc_id", "c0", F.greatest("c", F.coalesce("got", F.lit(0.0))).alias("c"), F.coalesce(F.col("got") - F.col("c"), F.lit(0.0)).alias("up")).checkpoint()
        moved = state.where(F.col("up") > tolerance).select("doc_id", "c")
        if moved.isEmpty():
            break
        state = state.select("doc_id", "c0", "c")
    return state.select("doc_id", (1 - F.col("c")).alias("p"), (1 - F.col("c0")).alias("p_direct"))


def _ensure_checkpoints(spark) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            root = f"file://{tempfile.mkdtemp(prefix='varve-')}"
        spark.sparkContext.setCheckpointDir(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
