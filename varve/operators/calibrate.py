"""Monotone maps from scores to probabilities: isotonic, linear in the log odds, and logistic by Newton steps."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .verdict import logit

#: (fixed values)
LEAST_ROWS, LEAST_P, LEAST_LOGISTIC = 12, 1e-4, 8


@dataclass(frozen=True)
class Calibrator:
    """A fitted map, or the identity. ``apply`` adds a column; nothing is collected but the knots of the map."""

    model: Any = None
    line: tuple[float, float] | None = None

    @property
    def fitted(self) -> bool:
        return self.model is not None or self.line is not None

    def apply(self, df: DataFrame, p: str = "p", into: str = "calibrated") -> DataFrame:
        """Values outside the fitted range take the map's ends; results stay LEAST_P away from 0 and 1; null stays null."""
        if self.line is not None:
            a, b = self.line
            mapped = df.withColumn(into, a * logit(F.col(p)) + b)
        elif self.model is not None:
            some = self.model.transform(df.where(F.col(p).isNotNull()).withColumn("_x", F.col(p).cast("double"))).drop("_x").withColumnRenamed("_y", into)
            mapped = some.unionByName(df.where(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double")))
        else:
            return df.withColumn(into, F.col(p).cast("double"))
        return mapped.withColumn(into, F.when(F.col(into).isNotNull(), F.least(F.greatest(F.col(into), F.lit(LEAST_P)), F.lit(1 - LEAST_P))))


def fit(df: DataFrame, p: str = "p", label: str = "label", isotonic: bool = True, places: int = 6) -> Calibrator:
    """From rows (p, label); the identity with fewer than LEAST_ROWS rows or one class. Equal scores are one weighted point.

    Scores are rounded to ``places`` before the fit, which bounds the points whatever the rows.
    """
    from pyspark.ml.regression import IsotonicRegression

    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).select(F.round(F.col(p), places).alias("_x"), F.col(label).cast("double").alias("y"))
    per = rows.groupBy("_x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("n"))
    n, low, high = per.agg(F.sum("n"), F.min("y"), F.max("y")).first()
    mixed = n and (low < high or 0 < low < 1)
    if not n or n < LEAST_ROWS or not mixed:
        return Calibrator()
    if isotonic:
        return Calibrator(model=IsotonicRegression(featuresCol="_x", labelCol="y", weightCol="n", predictionCol="_y").fit(per))
    z = logit(F.least(F.greatest(F.col("_x"), F.lit(1e-6)), F.lit(1 - 1e-6)))
    m = rows.select(z.alias("z"), "y").agg(F.covar_pop("z", "y").alias("c"), F.var_pop("z").alias("v"), F.avg("z").alias("z"), F.avg("y").alias("y")).first()
    a = m.c / m.v if m.v else 0.0
    return Calibrator(line=(a, m.y - a * m.z))


@dataclass(frozen=True)
class Logistic:
    """p = 1 / (1 + exp(-(a z + b))) of the standardised score z."""

    a: float = 1.0
    b: float = 0.0
    mean: float = 0.0
    sd: float = 1.0

    def column(self, score: str):
        return 1 / (1 + F.exp(-(self.a * (F.col(score) - self.mean) / self.sd + self.b)))


def fit_logistic(df: DataFrame, score: str = "score", label: str = "label", rounds: int = 60) -> Logistic:
    """By Newton steps; each is one aggregate of five sums. Without enough rows or with one class the slope is 1."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).persist()
    m = rows.agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    mean, sd = m.mean or 0.0, m.sd or 1.0
    if m.n < LEAST_LOGISTIC or m.lo == m.hi:
        rows.unpersist()
        return Logistic(mean=mean, sd=sd)
    x = (F.col("s") - mean) / sd
    per = rows.select(F.round(x, 12).alias("x"), "y").groupBy("x").agg(F.count("*").alias("n"), F.sum("y").alias("y")).persist()
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w, rest = F.col("n") * F.greatest(p * (1 - p), F.lit(1e-6)), F.col("y") - F.col("n") * p
        g0, g1, h00, h01, h11 = per.agg(F.sum(rest * F.col("x")), F.sum(rest), F.sum(w * F.col("x") ** 2), F.sum(w * F.col("x")), F.sum(w)).first()
        step = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + 1e-6 * np.eye(2), np.array([g0, g1]))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9 or not math.isfinite(a):
            break
    per.unpersist()
    rows.unpersist()
    return Logistic(a, b, mean, sd)
