"""Detectors that read the text alone, to be compared with dating: perplexity statistics, and a linear model of TF-IDF."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibrate, lm

#: (fixed values)
PERTURBATIONS, RATE, LEAST_WORDS, BURSTINESS, CURVATURE, MIN_DF, FEATURES, STRENGTH = 6, 0.12, 20, 0.5, 0.5, 2, 60_000, 4.0


def perturbed(docs: DataFrame, count: int = PERTURBATIONS, rate: float = RATE, seed: int = 0) -> DataFrame:
    """(doc_id, of, text): ``count`` versions of each text with about ``rate`` of the words dropped or doubled, by hashes of id, version and place."""
    rows = docs.select(F.col("doc_id").alias("of"), lm.words().alias("w"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j")).where(F.size("w") >= LEAST_WORDS)
    chance = lambda i: F.pmod(F.xxhash64("of", "j", i, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    none = F.array().cast("array<string>")
    words = F.flatten(F.transform("w", lambda w, i: F.when(chance(i) < rate / 2, none).when(chance(i) < rate, F.array(w, w)).otherwise(F.array(w))))
    return rows.select(F.concat_ws("#", F.col("of").cast("string"), F.col("j").cast("string")).alias("doc_id"), "of", F.array_join(words, " ").alias("text"))


def statistics(docs: DataFrame, model: DataFrame, vocabulary: int, order: int = 4) -> DataFrame:
    """(doc_id, logloss, burstiness, curvature): mean and deviation of the words' surprise, and what a perturbation costs. Short texts have 0."""
    base = lm.detectability(lm.log_probabilities(docs, model, vocabulary, order))
    moved = perturbed(docs)
    after = lm.detectability(lm.log_probabilities(moved.select("doc_id", "text"), model, vocabulary, order)).select(F.col("doc_id").alias("version"), F.col("logloss").alias("after"))
    mean = moved.select(F.col("doc_id").alias("version"), "of").join(after, "version").groupBy("of").agg(F.avg("after").alias("after"))
    rows = docs.select("doc_id").join(base, "doc_id", "left").join(mean.withColumnRenamed("of", "doc_id"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("doc_id", zero(F.col("logloss")).alias("logloss"), zero(F.col("burstiness")).alias("burstiness"), zero(F.col("after") - F.col("logloss")).alias("curvature"))


def raw_score(variant: str = "combined") -> Column:
    """Higher is more human by convention; the fit that follows learns the sign."""
    return {
        "perplexity": F.col("logloss"), "burstiness": F.col("burstiness"), "curvature": -F.col("curvature"),
        "combined": F.col("logloss") + BURSTINESS * F.col("burstiness") - CURVATURE * F.col("curvature"),
    }[variant]


@dataclass(frozen=True)
class StatisticalDetector:
    """A reference model of human texts, and a logistic map of the statistic."""

    model: DataFrame
    vocabulary: int
    logistic: calibrate.Logistic
    variant: str = "combined"
    order: int = 4

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, p)."""
        rows = statistics(docs, self.model, self.vocabulary, self.order).select("doc_id", raw_score(self.variant).alias("score"))
        return rows.select("doc_id", self.logistic.column("score").alias("p"))


def fit_statistical(reference: DataFrame, labelled: DataFrame, variant: str = "combined", order: int = 4) -> StatisticalDetector:
    """``reference`` (doc_id, text) are human texts; ``labelled`` (doc_id, text, label) fits the map."""
    model, vocabulary = lm.fit(reference, order), lm.vocabulary_size(reference, order)
    rows = statistics(labelled, model, vocabulary, order).select("doc_id", raw_score(variant).alias("score")).join(labelled.select("doc_id", "label"), "doc_id")
    return StatisticalDetector(model, vocabulary, calibrate.fit_logistic(rows), variant, order)


def grams(text: Column) -> Column:
    """Words and word pairs, and runs of three to five characters within words padded by a space on either side."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)"), F.lit(1))
    pairs = F.when(F.size(words) > 1, F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(n: int) -> Column:
        of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit("c:"), F.substr(w, i, F.lit(n))))
        return F.flatten(F.transform(padded, of))

    return F.concat(words, pairs, *[runs(n) for n in (3, 4, 5)])


#: Copies of a term in a document: STEPS * (1 + ln count), rounded. Vectors are scaled to length 1, so the factor has no effect.
STEPS = 4


def _terms(docs: DataFrame) -> DataFrame:
    """(doc_id, g): each document's grams, as often as their damped counts say. Documents without a gram have an empty array."""
    counted = docs.select("doc_id", F.explode(grams(F.coalesce("text", F.lit("")))).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("c"))
    times = F.round(STEPS * (1 + F.log("c"))).cast("int")
    lists = counted.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("g", times))).alias("g"))
    return docs.select("doc_id").distinct().join(lists, "doc_id", "left").select("doc_id", F.coalesce("g", F.array().cast("array<string>")).alias("g"))


@dataclass(frozen=True)
class LearnedDetector:
    stages: Any

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, p)."""
        from pyspark.ml.functions import vector_to_array

        rows = _terms(docs)
        for stage in self.stages:
            rows = stage.transform(rows)
        return rows.select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def fit_learned(labelled: DataFrame, features: int = FEATURES) -> LearnedDetector:
    """Logistic regression on damped TF-IDF of rows (doc_id, text, label). Terms in fewer than MIN_DF documents are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    marks = labelled.groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    rows = _terms(labelled).join(marks, "doc_id").persist()
    counter = CountVectorizer(inputCol="g", outputCol="c", vocabSize=features, minDF=MIN_DF).fit(rows)
    idf = IDF(inputCol="c", outputCol="i").fit(counter.transform(rows))
    scale = Normalizer(inputCol="i", outputCol="f")
    n = max(1, rows.count())
    linear = LogisticRegression(featuresCol="f", labelCol="label", regParam=1 / (STRENGTH * n), standardization=False, maxIter=200).fit(scale.transform(idf.transform(counter.transform(rows))))
    rows.unpersist()
    return LearnedDetector((counter, idf, scale, linear))


def dated_scores(verdicts: DataFrame, calibrator: calibrate.Calibrator | None = None) -> DataFrame:
    """(doc_id, p, confidence, abstained): dating as a detector; p is calibrated, confidence is what the interval leaves."""
    rows = verdicts.select("doc_id", F.col("human_origin_p").alias("p"), (1 - (F.col("ci_high") - F.col("ci_low"))).alias("confidence"), "abstained")
    return rows if calibrator is None else calibrator.apply(rows, "p", "_p").drop("p").withColumnRenamed("_p", "p")
