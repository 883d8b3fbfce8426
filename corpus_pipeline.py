"""A corpus pipeline of five stages: documents in, packed token pieces out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import mixing, neardup, packing, quality, substring
from varve.llm.common import keep, text_batches

#: Shares of the expected tokens by domain; good documents are all taken, once.
TARGETS = {"good": 0.97, "poor": 0.01, "toxic": 0.02}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    text_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, columns=docs.columns).where("predicted = 1").select("others.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, once. Rows with a null id stay."""
    text_batches(spark)
    found = keep(neardup.near_duplicates(docs).select("doc_id", "kept"))
    gone = keep(found.where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    twice = keep(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("gone")).count().where("count > 1").select("gone"))
    small = lambda ids: F.broadcast(ids) if ids.count() <= neardup.BROADCAST_IDS else ids
    left = docs.join(small(gone), docs["doc_id"] == gone["gone"], "left_anti")
    if twice.isEmpty():
        return left
    again = small(twice)
    order = F.struct(*[F.col(c) for c in docs.columns if c != "doc_id"])
    once = left.join(again, left["doc_id"] == twice["gone"], "left_semi").groupBy("doc_id").agg(F.min(order).alias("row"))
    once = once.select(*["doc_id" if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns])
    return once.unionByName(left.join(again, left["doc_id"] == twice["gone"], "left_anti"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; n_chars counts the text that is left."""
    text_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = substring.deduplicate_passages(docs, columns=others)

    def column(name: str):
        if name in ("doc_id", "text"):
            return F.col("doc_id" if name == "doc_id" else "clean").cast(docs.schema[name].dataType).alias(name)
        own = F.col("others").getField(name)
        if name == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.char_length("clean").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return done.select(*[column(c) for c in docs.columns])


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: good ones once, of the other domains a share that meets the targets."""
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = mixing.mix(docs, labelled, TARGETS, anchor="good", keep_whole=("good",), most=1.0, columns=docs.columns)
    return done.where("copies > 0").select("others.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    text_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("packing", pack),
]

#: Models and iterations are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs)
    return docs
