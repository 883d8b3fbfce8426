"""Readers and writers of documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_timestamp

#: Names under which inputs carry a field, in order of preference. (fixed values)
ID, TEXT, DATE = ("doc_id", "id", "url"), ("text", "content"), ("date", "published", "timestamp", "not_after")


def _first(df: DataFrame, names: tuple[str, ...]):
    there = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def read_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, text, url, claimed) of JSON lines or Parquet; rows without an id take one from their place in the file."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    df = df.limit(limit) if limit is not None else df
    url = F.col("url") if "url" in df.columns else F.lit(None)
    own = F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string"))
    return df.select(F.coalesce(_first(df, ID), own).alias("doc_id"), _first(df, TEXT).alias("text"), url.cast("string").alias("url"), to_timestamp(_first(df, DATE)).alias("claimed"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, url, not_after) of JSON lines; rows without text or date are dropped."""
    df = spark.read.json(path)
    when = to_timestamp(_first(df, ("not_after", "published")))
    url = F.col("url") if "url" in df.columns else F.lit(None)
    return df.select(_first(df, ID).alias("doc_id"), _first(df, TEXT).alias("text"), url.cast("string").alias("url"), when.alias("not_after")).where("text is not null and not_after is not null")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """One CSV of frames with different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)
