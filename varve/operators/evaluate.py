"""Evaluation of detectors: splits and roles, rates by condition, ablations, detectability gaps, costs and headline pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Contradictions that say a claimed date is forged. (fixed values)
FORGED = ("backdate", "commit_predates_repo")


def drawn(key: str, seed: int) -> Column:
    """A number in [0, 1) of a document, the same in any plan and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)


def split(rows: DataFrame, shares: dict[str, float], key: str = "doc_id", seed: int = 0, into: str = "split") -> DataFrame:
    """Adds the part that a document's number falls into; parts have their shares in expectation. No rank, so no shuffle."""
    at, part = 0.0, F.lit(list(shares)[-1])
    parts = []
    for name, share in shares.items():
        at += share
        parts.append((at, name))
    for edge, name in reversed(parts[:-1]):
        part = F.when(drawn(key, seed) < edge, name).otherwise(part)
    return rows.withColumn(into, part)


def roles(rows: DataFrame, sizes: dict[str, int], key: str = "doc_id", seed: int = 0, into: str = "role") -> DataFrame:
    """Adds disjoint roles of exact sizes, in the order of the documents' numbers; the rest is null.

    The order is cut by counting: only documents up to the last role's number are ranked, found among at most 4096 ranges.
    """
    total = sum(sizes.values())
    n = rows.withColumn("_n", drawn(key, seed))
    counts = sorted((r[0], r[1]) for r in n.groupBy(F.floor(F.col("_n") * 4096).cast("int").alias("b")).count().collect())
    seen, edge = 0, 4096
    for b, c in counts:
        seen += c
        if seen >= total:
            edge = b + 1
            break
    ranked = n.where(F.col("_n") * 4096 < edge).withColumn("_r", F.row_number().over(Window.orderBy("_n", key)))
    name, at = F.lit(None).cast("string"), total
    for role, size in reversed(list(sizes.items())):
        name = F.when(F.col("_r") <= at, role).otherwise(name)
        at -= size
    chosen = ranked.where(F.col("_r") <= total).select(F.col(key), name.alias(into))
    return rows.join(chosen, key, "left")


def backdate_rate(docs: DataFrame, flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, flag_rate): share of documents with a contradiction of FORGED. On forgeries detection, on others false alarms."""
    hit = flags.where(F.col("kind").isin(*FORGED)).select("doc_id").distinct().withColumn("hit", F.lit(1.0))
    return docs.join(hit, "doc_id", "left").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("flag_rate"))


def ablation(rows: DataFrame) -> DataFrame:
    """(variant, channel, reflow, matched, random, hash_hit, separation) of rows (variant, channel, kind, containment, same).

    ``kind`` is reflow, matched or random; separation is what matched pairs have above random ones.
    """
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.col("containment")))
    out = rows.groupBy("variant", "channel").agg(mean("reflow").alias("reflow"), mean("matched").alias("matched"), mean("random").alias("random"), F.avg(F.when(F.col("kind") == "reflow", F.col("same").cast("double"))).alias("hash_hit"))
    return out.withColumn("separation", F.col("matched") - F.col("random"))


def ancestor_recall(found: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, recall): share of documents (doc_id, source_id) whose true source is among the ancestors (doc_id, r_id)."""
    hit = found.select("doc_id", F.col("r_id").alias("source_id")).distinct().withColumn("hit", F.lit(1.0))
    return truth.join(hit, ["doc_id", "source_id"], "left").groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def detectability_gap(per_doc: DataFrame, side: str = "human") -> DataFrame:
    """One row of rows (doc_id, logloss, burstiness, human): means of both sides and their absolute gaps."""
    mean = lambda c, human: F.avg(F.when(F.col(side) == human, F.col(c)))
    out = per_doc.agg(*[mean(c, h).alias(f"{name}_{c}") for c in ("logloss", "burstiness") for h, name in ((True, "human"), (False, "synthetic"))])
    return out.withColumns({f"{c}_gap": F.abs(F.col(f"synthetic_{c}") - F.col(f"human_{c}")) for c in ("logloss", "burstiness")})


def headline(rows: DataFrame, value: str = "auc") -> DataFrame:
    """Per method of rows (method, seen, same_family, auc): mean AUC on seen and unseen generations and on another family, and the drops."""
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    own = F.col("same_family")
    out = rows.groupBy("method").agg(mean(own & F.col("seen")).alias("auc_seen"), mean(own & ~F.col("seen")).alias("auc_unseen"), mean(~own).alias("auc_other_family"))
    return out.withColumns({"drop_unseen": F.col("auc_seen") - F.col("auc_unseen"), "drop_family": F.col("auc_seen") - F.col("auc_other_family")})


def costs(rows: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """(by, n, seconds, seconds_per_document, hits, misses, hit_rate) of rows (by, seconds, documents, hits, misses)."""
    out = rows.groupBy(*by).agg(F.sum("documents").alias("n"), F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return out.withColumns({"seconds_per_document": F.col("seconds") / F.when(F.col("n") > 0, F.col("n")), "hit_rate": F.col("hits") / F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") + F.col("misses"))})


def shares(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, share) of groups among all rows: roles, eras, layers."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("_all")))).select(*by, "n", (F.col("n") / F.col("_all")).alias("share"))
