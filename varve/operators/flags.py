"""Contradictions between claimed and observed dates, as a long table (doc_id, kind, log_lr, severity, claimed, observed, coverage, sources)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .witness import covering, independent, silence_logodds

#: Thresholds in days and log-likelihood ratios. (fixed values)
LATE_DAYS, FORGED_DAYS, COMMIT_DAYS, DISAGREE_DAYS = 365, 730, 30, 3 * 365
LEAST_LOG_LR, COMMIT_LOG_LR, POSTDATE_LOG_LR, DISAGREE_LOG_LR = 0.5, 5.0, 1.0, 0.6
#: Kinds whose log_lr counts against a document.
DECEPTIVE = ("backdate", "commit_predates_repo")


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days, rounded down also below zero."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))


def severity(log_lr: Column) -> Column:
    return F.when(log_lr >= 4, "high").when(log_lr >= 1.5, "medium").otherwise("low")


def detect(targets: DataFrame, witnesses: DataFrame, bounds: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Flags of ``targets`` (doc_id, claimed, coverage: map source -> share).

    A missing claim falls back to the earliest self-asserted record. ``as_of`` stands for the present in the rule on claims that
    no archive confirms, so results can be repeated. One aggregate of the witnesses per document feeds every rule.
    """
    ind = independent()
    by_op = witnesses.groupBy("doc_id", "operator").agg(
        F.min(F.when(ind, F.col("observed_at"))).alias("seen"), F.min(F.when(~ind, F.col("observed_at"))).alias("said"),
        F.array_sort(F.collect_set(F.when((F.col("kind") == "commit") & (days_between(F.col("observed_at"), F.col("repo_created_at")) > COMMIT_DAYS), F.struct("observed_at", "repo_created_at", "source_id")))).alias("commits"),
    )
    facts = by_op.groupBy("doc_id").agg(
        F.min("seen").alias("seen"), F.max("seen").alias("latest"), F.count("seen").alias("n_ops"), F.min("said").alias("said"),
        F.array_sort(F.collect_list(F.when(F.col("seen").isNotNull(), F.col("operator")))).alias("ops"), F.flatten(F.collect_list("commits")).alias("commits"),
    )
    rows = targets.join(facts, "doc_id", "left").join(bounds.select("doc_id", "not_after", "independent_operators"), "doc_id", "left")
    claimed = F.coalesce("claimed", "said")
    none = F.array().cast("array<string>")
    gap, over = days_between(F.col("c"), F.col("seen")), covering(F.col("coverage"))
    most = F.coalesce(F.array_max(F.map_values("over")), F.lit(0.0))
    late_lr = F.greatest(F.col("silence"), F.lit(0.0)) + F.least(F.lit(1.0), F.col("gap") / 3650.0)

    def flag(when: Column, kind: str, log_lr: Column, claimed: Column, observed: Column, coverage: Column, sources: Column) -> Column:
        made = F.struct(F.lit(kind).alias("kind"), log_lr.cast("double").alias("log_lr"), claimed.alias("claimed"), observed.alias("observed"), coverage.cast("double").alias("coverage"), sources.alias("sources"))
        return F.when(when, F.array(made))

    rows = rows.withColumn("c", claimed).withColumn("coverage", F.coalesce("coverage", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    rows = rows.withColumn("gap", gap).withColumn("over", over).withColumn("silence", silence_logodds(F.col("coverage")))
    never, zero = F.lit(None).cast("timestamp"), F.lit(0.0)
    sources = F.array_sort(F.map_keys("over"))
    found = [
        flag((F.col("gap") > LATE_DAYS) & (late_lr > LEAST_LOG_LR), "backdate", late_lr, F.col("c"), F.col("seen"), most, sources),
        flag(F.col("seen").isNull() & (F.size("over") > 0) & (days_between(F.col("c"), F.lit(as_of)) > FORGED_DAYS), "backdate", F.col("silence"), F.col("c"), never, most, sources),
        flag(days_between(F.col("seen"), F.col("c")) > LATE_DAYS, "postdate", F.lit(POSTDATE_LOG_LR), F.col("c"), F.col("seen"), zero, none),
        F.transform(
            F.coalesce("commits", F.array().cast(facts.schema["commits"].dataType)),
            lambda x: F.struct(F.lit("commit_predates_repo").alias("kind"), F.lit(COMMIT_LOG_LR).alias("log_lr"), x["observed_at"].alias("claimed"), x["repo_created_at"].alias("observed"), F.lit(1.0).alias("coverage"), F.array(x["source_id"]).alias("sources")),
        ),
        flag((F.col("n_ops") >= 2) & (days_between(F.col("seen"), F.col("latest")) > DISAGREE_DAYS), "operator_disagreement", F.lit(DISAGREE_LOG_LR), never, F.col("seen"), zero, F.col("ops")),
        flag(F.col("not_after").isNotNull() & (F.col("independent_operators") == 1), "single_operator", zero, never, F.col("not_after"), zero, F.slice("ops", 1, 1)),
    ]
    kind = "array<struct<kind:string,log_lr:double,claimed:timestamp,observed:timestamp,coverage:double,sources:array<string>>>"
    every = F.concat(*[F.coalesce(f.cast(kind), F.array().cast(kind)) for f in found])
    out = rows.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")
    return out.select("doc_id", "kind", "log_lr", severity(F.col("log_lr")).alias("severity"), "claimed", "observed", "coverage", "sources")


def by_document(flags: DataFrame) -> DataFrame:
    """(doc_id, penalty, n_flags, worst): what the probability and the abstention need."""
    return flags.groupBy("doc_id").agg(
        F.sum(F.when(F.col("kind").isin(*DECEPTIVE), F.col("log_lr")).otherwise(0.0)).alias("penalty"), F.count("*").alias("n_flags"),
        F.max(F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)).alias("worst"),
    )


def counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")
