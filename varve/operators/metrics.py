"""Ranking and calibration metrics over (score or p, label), optionally by group columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str = "p", label: str = "label", by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve by midranks; a tie counts one half; null with one class only.

    Ranks are taken over distinct scores with their counts, so rows combine before the shuffle and ties cost nothing.
    """
    by = list(by)
    per = df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    below = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("pos")
    won = per.withColumn("below", F.coalesce(F.sum(neg).over(below), F.lit(0))).withColumn("neg", neg)
    out = won.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / F.col("n_pos") / F.col("n_neg")).alias("auc"))


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability_bins(df: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """(bin, bin_low, bin_high, n, mean_predicted, observed_frequency); means of empty bins are null."""
    found = df.groupBy(_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed_frequency"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.col("bin") / bins).alias("bin_low"), ((F.col("bin") + 1) / bins).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "observed_frequency")


def calibration(df: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """One row: n, ece, brier."""
    b = df.groupBy(_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("m"), F.avg(F.col(label).cast("double")).alias("o"), F.sum((F.col(p) - F.col(label)) ** 2).alias("b"))
    return b.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("m") - F.col("o"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"))


def risk_coverage(df: DataFrame, score: str = "p", label: str = "label", confidence: str = "confidence", key: str = "doc_id", points: int = 21) -> DataFrame:
    """Per coverage level: the k most confident rows, their error when split at their median score, and their AUC.

    Ranks by confidence come from counts of its distinct values plus a rank within equal ones; each level is then
    an ordinary aggregate over the rows within it.
    """
    rows = df.select(F.col(score).alias("s"), F.col(label).cast("int").alias("y"), F.col(confidence).alias("c"), F.col(key).alias("k"))
    per = rows.groupBy("c").agg(F.count("*").alias("n"))
    before = per.select("c", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("k"))).join(before, "c").withColumn("rank", F.col("r") + F.col("before"))
    total = rows.agg(F.count("*").alias("total"))
    levels = df.sparkSession.range(1, points + 1).join(F.broadcast(total)).select(F.col("id").cast("int").alias("level"), "total", F.greatest(F.lit(2), F.rint(F.col("id") / points * F.col("total")).cast("int")).alias("k"))
    inside = ranked.join(F.broadcast(levels.withColumnRenamed("k", "top")), F.col("rank") <= F.col("top"))
    mid = inside.groupBy("level").agg(F.median("s").alias("threshold"), F.count("*").alias("n"), F.avg(F.col("top") / F.col("total")).alias("coverage"))
    wrong = inside.join(F.broadcast(mid), "level").groupBy("level", "n", "coverage").agg(F.avg(F.when(F.col("y") != F.when(F.col("s") > F.col("threshold"), 1).otherwise(0), 1.0).otherwise(0.0)).alias("error"))
    ranks = auc(inside, "s", "y", ["level"])
    return wrong.join(ranks, "level").select("level", "coverage", "n", F.when(F.col("auc").isNotNull(), F.col("error")).alias("error"), "auc")


def evaluation(df: DataFrame, p: str = "p", label: str = "label", abstained: str = "abstained", by: list[str] = ()) -> DataFrame:
    """Per group: n, auc, ece, brier, mean p and abstention of both classes."""
    by = list(by)
    pos, neg = F.col(label) == 1, F.col(label) == 0
    rate = lambda c: F.avg(F.when(c, F.col(abstained).cast("double")))
    rows = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.avg(F.when(pos, F.col(p))).alias("mean_p_pos"), F.avg(F.when(neg, F.col(p))).alias("mean_p_neg"),
        F.avg(F.col(abstained).cast("double")).alias("abstain"), rate(pos).alias("abstain_pos"), rate(neg).alias("abstain_neg"),
    )
    scored = auc(df, p, label, by)
    bins = df.groupBy(*by, _bin(F.col(p), 10).alias("bin")).agg(F.count("*").alias("m"), F.avg(p).alias("x"), F.avg(F.col(label).cast("double")).alias("y"))
    error = bins.groupBy(*by).agg((F.sum(F.col("m") * F.abs(F.col("x") - F.col("y"))) / F.sum("m")).alias("ece"))
    return rows.join(scored, by).join(error, by) if by else rows.join(F.broadcast(scored)).join(F.broadcast(error))
