"""Witness records to an existence bound: grouping by operator, running failure probability, first clearing time.

Witness columns: doc_id, source_id, operator, kind, observed_at, reliability, forgeability, field, repo_created_at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Witness kinds; only the last is under the author's control. (fixed values)
KINDS = ("snapshot", "registration", "commit", "posting", "publication", "citation", "self_asserted")
SELF_ASSERTED = "self_asserted"


@dataclass(frozen=True)
class ConsensusConfig:
    """Failure budgets of the bound and of both ends of its interval, and the worth of a repeated capture. (fixed values)"""

    alpha: float = 1e-2
    alpha_tight: float = 1e-4
    alpha_loose: float = 5e-2
    rho: float = 0.15
    require_independent: bool = True


def validate(witnesses: DataFrame) -> DataFrame:
    """Fails at run time on probabilities outside [0, 1] and on unknown kinds."""
    ok = F.col("reliability").between(0, 1) & F.col("forgeability").between(0, 1) & F.col("kind").isin(*KINDS)
    fault = F.raise_error(F.concat(F.lit("not a witness of document "), F.col("doc_id").cast("string")))
    return witnesses.withColumn("reliability", F.when(F.coalesce(ok, F.lit(False)), F.col("reliability")).otherwise(fault.cast("double")))


def independent(kind: str | Column = "kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind) != SELF_ASSERTED


def dedupe(witnesses: DataFrame) -> DataFrame:
    """The earliest record per document, operator, kind, UTC day and field; ties by source, then by the other columns.

    A grouped minimum, so a document with many captures is reduced before the shuffle.
    """
    keys = ["doc_id", "operator", "kind", "day", "field"]
    rest = ["observed_at", "source_id", "reliability", "forgeability", "repo_created_at"]
    daily = witnesses.withColumn("day", F.to_date("observed_at"))
    first = daily.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("w"))
    return first.select("doc_id", "operator", "kind", "field", *[F.col("w")[c].alias(c) for c in rest])


def operator_failure(witnesses: DataFrame, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Per document over all its witnesses: log_p (all of them wrong), operators, ess (effective sample size)."""
    q, ess = _group_failure(F.min("forgeability"), F.sum(_slip()), F.count("*"), cfg)
    by_op = witnesses.groupBy("doc_id", "operator").agg(q.alias("log_q"), ess.alias("ess"))
    return by_op.groupBy("doc_id").agg(F.sum("log_q").alias("log_p"), F.count("*").alias("operators"), F.sum("ess").alias("ess"))


def _slip() -> Column:
    return F.log(F.greatest(F.lit(1e-9), 1 - F.col("reliability")))


def _group_failure(f: Column, slips: Column, n: Column, cfg: ConsensusConfig) -> tuple[Column, Column]:
    """An operator's records fail together (forged) or one by one (mistaken)."""
    return F.log(F.greatest(F.lit(1e-300), F.least(F.lit(1.0), f + (1 - f) * F.exp(slips)))), 1 + (n - 1) * F.lit(cfg.rho)


def running_failure(witnesses: DataFrame, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """(doc_id, t, log_p, operators, ess) of the witnesses up to each time t of a document.

    Per operator the running minimum, sum and count give its share at each of its times; changes of that share, added up over
    operators in time order, give the whole. One exchange by document serves all windows.
    """
    used = witnesses.where(independent()) if cfg.require_independent else witnesses
    at = used.groupBy("doc_id", "operator", F.col("observed_at").alias("t")).agg(F.min("forgeability").alias("f"), F.sum(_slip()).alias("slip"), F.count("*").alias("n"))
    at = at.repartition("doc_id")
    by_op = Window.partitionBy("doc_id", "operator").orderBy("t")
    run = by_op.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_q, ess = _group_failure(F.min("f").over(run), F.sum("slip").over(run), F.sum("n").over(run), cfg)
    steps = at.withColumn("log_q", log_q).withColumn("e", ess)
    steps = steps.select(
        "doc_id", "t",
        (F.col("log_q") - F.coalesce(F.lag("log_q").over(by_op), F.lit(0.0))).alias("dq"),
        (F.col("e") - F.coalesce(F.lag("e").over(by_op), F.lit(0.0))).alias("de"),
        F.when(F.lag("t").over(by_op).isNull(), 1).otherwise(0).alias("dn"),
    )
    at_time = steps.groupBy("doc_id", "t").agg(F.sum("dq").alias("dq"), F.sum("de").alias("de"), F.sum("dn").alias("dn"))
    upto = Window.partitionBy("doc_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at_time.select("doc_id", "t", F.sum("dq").over(upto).alias("log_p"), F.sum("dn").over(upto).alias("operators"), F.sum("de").over(upto).alias("ess"))


def consensus(witnesses: DataFrame, cfg: ConsensusConfig = ConsensusConfig()) -> DataFrame:
    """Per document: not_after, not_after_low, not_after_high, independent_operators, effective_witnesses, forgery_logodds, method.

    not_after is the first time at which the evidence so far fails with probability at most alpha. Where no time clears it, it is
    the last time, and method says so. Documents with self-asserted records only get nulls, as do
    documents without any in a join with this result.
    """
    run = running_failure(witnesses, cfg).withColumn("s", F.struct("t", "log_p", "operators", "ess"))
    clears = lambda alpha: F.col("log_p") <= F.lit(math.log(alpha) + 1e-12)
    best = run.groupBy("doc_id").agg(
        F.min(F.when(clears(cfg.alpha), F.col("s"))).alias("hit"), F.max("s").alias("last"),
        F.min(F.when(clears(cfg.alpha_loose), F.col("t"))).alias("low"), F.min(F.when(clears(cfg.alpha_tight), F.col("t"))).alias("high"),
    )
    at = F.coalesce("hit", "last")
    bound = best.select(
        "doc_id", at["t"].alias("not_after"), F.coalesce("low", at["t"]).alias("not_after_low"), F.coalesce("high", F.col("last")["t"]).alias("not_after_high"),
        at["operators"].cast("int").alias("independent_operators"), at["ess"].alias("effective_witnesses"), (-F.greatest(at["log_p"], F.lit(math.log(1e-300)))).alias("forgery_logodds"),
        F.when(F.col("hit").isNull(), "best-effort-below-alpha").otherwise("weighted-order-statistic").alias("method"),
    )
    if not cfg.require_independent:
        return bound
    every = witnesses.groupBy("doc_id").agg(F.count_if(independent()).alias("n"))
    none = every.where("n = 0").select("doc_id")
    empty = [F.lit(None).cast(bound.schema[c].dataType).alias(c) for c in ("not_after", "not_after_low", "not_after_high")]
    return bound.unionByName(none.select("doc_id", *empty, F.lit(0).alias("independent_operators"), F.lit(0.0).alias("effective_witnesses"), F.lit(0.0).alias("forgery_logodds"), F.lit("no-independent-evidence").alias("method")))


def covering(coverage: Column, least: float = 0.05) -> Column:
    """Entries of a map source -> coverage that count as covering."""
    return F.map_filter(coverage, lambda _, c: c > least)


def silence_logodds(coverage: Column) -> Column:
    """How unlikely it is that covering sources all missed a document: - sum ln(1 - c)."""
    return F.aggregate(F.map_values(covering(coverage)), F.lit(0.0), lambda s, c: s - F.log(F.greatest(F.lit(1e-6), 1 - c)))
