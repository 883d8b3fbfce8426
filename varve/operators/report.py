"""Corpus reports over verdicts (doc_id, not_after, human_origin_p, ci_low, ci_high, abstained, n_flags, independent_operators)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (fixed values)
CUTOFF = dt.datetime(2021, 1, 1)
FRACTIONS = (0.01, 0.02, 0.05, 0.10, 0.20)
SLACK = 1e-12


def background(cutoff: dt.datetime = CUTOFF, min_p: float = 0.90, use_ci: bool = True) -> Column:
    """low_background, contaminated or unknown; unknown is never folded into either other."""
    p, cut = F.col("ci_low" if use_ci else "human_origin_p"), F.lit(cutoff).cast("timestamp")
    old = F.col("not_after") < cut
    return F.when(old & (p >= min_p), "low_background").when(~old, "contaminated").otherwise("unknown")


def low_background_ratio(verdicts: DataFrame, cutoff: dt.datetime = CUTOFF, min_p: float = 0.90, use_ci: bool = True) -> DataFrame:
    """One row: n and the three shares; zeros for no verdicts."""
    kind = verdicts.select(background(cutoff, min_p, use_ci).alias("k"))
    share = lambda k: F.coalesce(F.avg(F.when(F.col("k") == k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(k)
    return kind.agg(F.count("*").alias("n"), share("low_background"), share("unknown"), share("contaminated"))


def probability_histogram(verdicts: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, bin_low, bin_high, n): equal bins of [0, 1], the last closed, empty ones included."""
    at = F.least(F.floor(F.col("human_origin_p") * bins), F.lit(bins - 1)).cast("int")
    found = verdicts.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = verdicts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.col("bin") / bins).alias("bin_low"), ((F.col("bin") + 1) / bins).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"))


def year_histogram(verdicts: DataFrame) -> DataFrame:
    """(year, n), years as text, the undated last as no-evidence."""
    return verdicts.groupBy(F.coalesce(F.year("not_after").cast("string"), F.lit("no-evidence")).alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def evidence_profile(witnesses: DataFrame) -> DataFrame:
    """(by, name, n): independent witnesses by operator and by source, in one pass over both grouping sets."""
    rows = witnesses.where("kind <> 'self_asserted'").groupingSets([[F.col("operator")], [F.col("source_id")]], "operator", "source_id")
    named = rows.agg(F.count("*").alias("n"), F.grouping("source_id").alias("g"))
    return named.select(F.when(F.col("g") == 1, "operator").otherwise("source").alias("by"), F.when(F.col("g") == 1, F.col("operator")).otherwise(F.col("source_id")).alias("name"), "n")


def summary(verdicts: DataFrame, cutoff: dt.datetime = CUTOFF, min_p: float = 0.90) -> DataFrame:
    """One row of corpus means, rates and the three-valued background."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    kind = background(cutoff, min_p)
    return verdicts.agg(
        F.count("*").alias("n"), F.avg("human_origin_p").alias("mean_human_origin_p"), F.median("human_origin_p").alias("median_human_origin_p"),
        F.avg(F.col("ci_high") - F.col("ci_low")).alias("mean_ci_width"), rate(F.col("abstained")).alias("abstain_rate"),
        rate(F.col("not_after").isNotNull()).alias("with_evidence_rate"), rate(F.col("n_flags") > 0).alias("flagged_rate"),
        F.avg(F.coalesce("independent_operators", F.lit(0))).alias("mean_independent_operators"), rate(F.col("independent_operators") == 1).alias("single_operator_share"),
        rate(kind == "low_background").alias("low_background"), rate(kind == "unknown").alias("unknown"), rate(kind == "contaminated").alias("contaminated"),
    )


def _prefixes(verdicts: DataFrame, mode: str, x: Column) -> DataFrame:
    """Groups of equal p in falling order with rows before and the sum of (1 - p) - x before, per constraint x.

    Only distinct probabilities (at most 1e6 + 1: p is rounded to 6 places) are ordered in one place; documents are not.
    """
    p = F.round(F.col("ci_low" if mode == "conservative" else "human_origin_p"), 6)
    groups = verdicts.groupBy(p.alias("p")).agg(F.count("*").alias("n")).withColumn("x", F.explode(x))
    upto = Window.partitionBy("x").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    cost = F.col("n") * (1 - F.col("p") - F.col("x"))
    return groups.withColumn("k0", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("s0", F.coalesce(F.sum(cost).over(upto), F.lit(0.0)))


def _plans(verdicts: DataFrame, fractions: tuple[float, ...], mode: str) -> DataFrame:
    """Per constraint the largest k for which the k documents with the highest p stay within it."""
    g = _prefixes(verdicts, mode, F.array(*[F.lit(float(f)) for f in fractions])).withColumn("c", 1 - F.col("p") - F.col("x"))
    room = F.floor((F.lit(SLACK) - F.col("s0")) / F.col("c") + 1e-9)
    fit = F.when(F.col("c") <= 0, F.when(F.col("s0") + F.col("n") * F.col("c") <= SLACK, F.col("n"))).otherwise(F.when(room >= 1, F.least(room, F.col("n"))))
    took = g.withColumn("m", F.coalesce(fit.cast("bigint"), F.lit(0)))
    total = F.sum("n").alias("n_total")
    best = F.max(F.when(F.col("m") > 0, F.struct((F.col("k0") + F.col("m")).alias("k"), F.col("p"), (F.col("s0") + F.col("m") * F.col("c")).alias("s")))).alias("b")
    plans = took.groupBy("x").agg(best, total)
    k = F.coalesce(F.col("b.k"), F.lit(0))
    return plans.select(
        F.col("x").alias("max_fraction"), F.lit(mode).alias("mode"), k.alias("n_selected"), "n_total", F.coalesce(F.col("b.p"), F.lit(1.0)).alias("threshold_p"),
        F.coalesce(F.col("b.s") / F.col("b.k") + F.col("x"), F.lit(0.0)).alias("expected_fraction"), (k / F.col("n_total")).alias("retention"),
    )


def subset_curve(verdicts: DataFrame, fractions: tuple[float, ...] = FRACTIONS, mode: str = "expected") -> DataFrame:
    """One row per constraint: the largest subset whose expected machine-made share stays within it. Always optimal: among
    sets of one size the one with the highest p costs least."""
    return _plans(verdicts, fractions, mode)


def subset(verdicts: DataFrame, fraction: float = 0.05, mode: str = "expected") -> DataFrame:
    """The selected documents (doc_id, p), ties at the threshold by doc_id.

    Those above the threshold are a plain filter; only documents tied at it are ordered.
    """
    p = F.round(F.col("ci_low" if mode == "conservative" else "human_origin_p"), 6)
    plan = _plans(verdicts, (fraction,), mode).select("n_selected", "threshold_p")
    rows = verdicts.select("doc_id", p.alias("p")).join(F.broadcast(plan), F.col("p") >= F.col("threshold_p")).where("n_selected > 0")
    above = rows.where("p > threshold_p").select("doc_id", "p")
    tied = rows.where("p = threshold_p")
    n_above = verdicts.select(p.alias("p")).join(F.broadcast(plan), F.col("p") > F.col("threshold_p")).agg(F.count("*").alias("n_above"))
    ranked = tied.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("doc_id"))).join(F.broadcast(n_above))
    return above.unionByName(ranked.where("r <= n_selected - n_above").select("doc_id", "p"))
