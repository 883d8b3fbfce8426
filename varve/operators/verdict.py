"""From bound, ancestor and flags to a probability of human origin with an interval; never to a label."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PrevalenceCurve:
    """Share of machine-made documents by time. (fixed values)"""

    midpoint: float | Column = 2023.4
    steepness: float | Column = 1.35
    floor: float | Column = 0.004
    ceiling: float | Column = 0.45

    def share(self, when: Column) -> Column:
        year = decimal_year(when)
        rise = 1 / (1 + F.exp(-F.lit(self.steepness) * (year - self.midpoint)))
        return F.when(when.isNull(), self.ceiling).otherwise(F.lit(self.floor) + (F.lit(self.ceiling) - self.floor) * rise)


#: Curves of the sensitivity sweep. (fixed values)
SWEEP = {
    "default": PrevalenceCurve(),
    "early_onset": PrevalenceCurve(midpoint=2022.5),
    "late_onset": PrevalenceCurve(midpoint=2024.5),
    "low_ceiling": PrevalenceCurve(ceiling=0.20),
    "high_ceiling": PrevalenceCurve(ceiling=0.70),
    "shallow": PrevalenceCurve(steepness=0.6),
}


@dataclass(frozen=True)
class VerdictConfig:
    """(fixed values)"""

    curve: PrevalenceCurve = PrevalenceCurve()
    kappa: float = 2.5
    mass: float = 0.90
    abstain_width: float = 0.34
    flag_weight: float = 1.0
    cells: int = 1000


def decimal_year(when: Column) -> Column:
    start = F.date_trunc("year", when)
    end = F.date_trunc("year", start + F.expr("INTERVAL 370 DAYS"))
    return F.year(when) + (F.unix_micros(when) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))


def logit(p: Column) -> Column:
    clamped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(clamped / (1 - clamped))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def alignment_strength(confidence: Column) -> Column:
    return F.least(F.lit(6.0), -F.log(F.greatest(F.lit(1e-6), 1 - F.least(F.lit(0.999), confidence))))


def raw_probability(when: Column, strength: Column, penalty: Column, cfg: VerdictConfig = VerdictConfig()) -> Column:
    """Human share at the bound if the evidence holds, the base rate if it fails; deception lowers the odds."""
    fail = F.when(strength > 0, F.exp(-strength)).otherwise(1.0)
    p = (1 - fail) * (1 - cfg.curve.share(when)) + fail * (1 - F.lit(cfg.curve.ceiling))
    weighed = cfg.flag_weight * F.coalesce(penalty, F.lit(0.0))
    p = F.when(weighed > 0, sigmoid(logit(p) - weighed)).otherwise(p)
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def beta_interval(p: np.ndarray, strength: np.ndarray, cfg: VerdictConfig = VerdictConfig()) -> tuple[np.ndarray, np.ndarray]:
    """Equal-tailed interval of the Beta whose weight grows with the evidence, by midpoint quadrature.

    Both parameters are at least 1, so the density is bounded; a quantile is placed within its cell in proportion.
    """
    k = cfg.kappa * (1 + np.maximum(0.0, strength))
    a, b = (p * k)[:, None], ((1 - p) * k)[:, None]
    x = (np.arange(cfg.cells) + 0.5) / cfg.cells
    log_w = a * np.log(x) + b * np.log1p(-x)
    w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
    c = np.cumsum(w, axis=1)
    tail = (1 - cfg.mass) / 2
    out = []
    for share in (tail, 1 - tail):
        need = share * c[:, -1]
        i = np.minimum((c < need[:, None]).sum(axis=1), cfg.cells - 1)
        at = np.arange(len(p))
        out.append(np.clip((i + (need - (c[at, i] - w[at, i])) / w[at, i]) / cfg.cells, 0, 1))
    return out[0], out[1]


def with_interval(df: DataFrame, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """Adds ci_low and ci_high for columns p and strength. Equal pairs (p, strength) are computed once."""
    pairs = df.select("p", "strength").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                p, strength = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("p", "strength"))
                lo, hi = beta_interval(np.nan_to_num(p, nan=0.5), np.nan_to_num(strength), cfg)
                none = np.isnan(p) | np.isnan(strength)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lo, mask=none), pa.array(hi, mask=none)], ["_p", "_strength", "ci_low", "ci_high"])

    made = pairs.mapInArrow(run, "_p double, _strength double, ci_low double, ci_high double")
    return df.join(made, F.col("p").eqNullSafe(F.col("_p")) & F.col("strength").eqNullSafe(F.col("_strength")), "left").drop("_p", "_strength")


def verdicts(bounds: DataFrame, penalties: DataFrame | None = None, ancestors: DataFrame | None = None, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """(doc_id, not_after, human_origin_p, ci_low, ci_high, abstained, n_flags, strength, independent_operators).

    ``bounds`` as of consensus; ``penalties`` (doc_id, penalty, n_flags, worst); ``ancestors`` (doc_id, witness_time, confidence) holds
    at most one dated ancestral match per document. An ancestor counts only if strictly older than the bound.
    """
    rows = bounds
    if penalties is not None:
        rows = rows.join(penalties, "doc_id", "left")
    else:
        rows = rows.withColumns({"penalty": F.lit(0.0), "n_flags": F.lit(0).cast("bigint"), "worst": F.lit(None).cast("int")})
    if ancestors is not None:
        rows = rows.join(ancestors.select("doc_id", "witness_time", "confidence"), "doc_id", "left")
    else:
        rows = rows.withColumns({"witness_time": F.lit(None).cast("timestamp"), "confidence": F.lit(None).cast("double")})
    older = F.col("witness_time").isNotNull() & (F.col("not_after").isNull() | (F.col("witness_time") < F.col("not_after")))
    when = F.when(older, F.col("witness_time")).otherwise(F.col("not_after"))
    strength = F.when(older, F.greatest(F.col("forgery_logodds"), alignment_strength(F.col("confidence")))).otherwise(F.col("forgery_logodds"))
    rows = rows.withColumn("at", when).withColumn("strength", F.round(strength, 9))
    rows = rows.withColumn("p", F.round(raw_probability(F.col("at"), F.col("strength"), F.col("penalty"), cfg), 9))
    rows = with_interval(rows, cfg)
    wide = F.col("ci_high") - F.col("ci_low") > cfg.abstain_width
    abstained = F.when(F.col("witness_time").isNotNull(), wide).otherwise(wide | F.col("not_after").isNull())
    return rows.select(
        "doc_id", F.least("not_after", "witness_time").alias("not_after"), F.col("p").alias("human_origin_p"), "ci_low", "ci_high", abstained.alias("abstained"),
        F.coalesce("n_flags", F.lit(0)).cast("bigint").alias("n_flags"), "strength", "independent_operators",
        F.when(F.coalesce("worst", F.lit(0)) >= 2, "flagged").when(abstained, "abstained").otherwise("ok").alias("status"),
    )


def sweep(rows: DataFrame, curves: dict[str, PrevalenceCurve] = SWEEP) -> DataFrame:
    """(doc_id, curve, p) of rows (doc_id, not_after, strength, penalty): the probability under each curve, in one pass."""
    given = F.array(*[F.struct(F.lit(n).alias("curve"), F.lit(c.midpoint).alias("mid"), F.lit(c.steepness).alias("steep"), F.lit(c.floor).alias("floor"), F.lit(c.ceiling).alias("ceiling")) for n, c in curves.items()])
    rows = rows.withColumn("x", F.explode(given))
    curve = PrevalenceCurve(*[F.col(f"x.{k}") for k in ("mid", "steep", "floor", "ceiling")])
    return rows.select("doc_id", "x.curve", F.round(raw_probability(F.col("not_after"), F.col("strength"), F.col("penalty"), VerdictConfig(curve=curve)), 9).alias("p"))


def explain(verdicts: DataFrame) -> DataFrame:
    """Adds a line of text per verdict that says what the number rests on."""
    dated = F.concat(F.lit("existed by "), F.date_format("not_after", "yyyy-MM-dd"), F.lit(" on the word of "), F.col("independent_operators").cast("string"), F.lit(" independent operator(s)"))
    return verdicts.withColumn("explanation", F.concat_ws(
        "; ", F.coalesce(dated, F.lit("no independent evidence of its age")),
        F.format_string("probability of human origin %.3f, interval %.3f to %.3f", "human_origin_p", "ci_low", "ci_high"),
        F.when(F.col("n_flags") > 0, F.format_string("%d contradiction(s)", "n_flags")), F.when(F.col("abstained"), "too wide to say"),
    ))
