"""Corpus records from harvested responses: metadata records of an archive, and the oldest usable captures of seed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

#: (fixed values)
LEAST_ABSTRACT_WORDS, LEAST_BODY, MOST_BODY, FIRST_YEAR, LAST_YEAR, RECENT = 90, 800, 120_000, 2015, 2020, 2021


def _tag(xml: Column, name: str) -> Column:
    found = F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1)
    plain = F.trim(F.regexp_replace(found, r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def era(when: Column) -> Column:
    return F.when(F.year(when) < RECENT, "old").otherwise("recent")


def oai_records(responses: DataFrame) -> DataFrame:
    """(doc_id, title, text, created, era) of harvested record lists (status, body); abstracts of fewer than LEAST_ABSTRACT_WORDS words are left out."""
    records = F.regexp_extract_all("body", F.lit(r"(?s)<record>(.*?)</record>"), F.lit(1))
    rows = responses.where("status = 200").select(F.explode(records).alias("r"))
    made = rows.select(_tag(F.col("r"), "id").alias("doc_id"), _tag(F.col("r"), "title").alias("title"), _tag(F.col("r"), "abstract").alias("text"), dates.to_timestamp(_tag(F.col("r"), "created")).alias("created"))
    return made.where((F.col("doc_id") != "") & F.col("created").isNotNull() & (words(F.col("text")) >= LEAST_ABSTRACT_WORDS)).withColumn("era", era(F.col("created")))


def resumption(responses: DataFrame) -> DataFrame:
    """(token): where the next page of each list starts; none for the last."""
    return responses.where("status = 200").select(_tag(F.col("body"), "resumptionToken").alias("token")).where("token <> ''")


def seed_pages(captures: DataFrame) -> DataFrame:
    """(url, text, captured): the oldest usable capture of each seed among rows (url, status, body, captured).

    Usable is a good status, a year from FIRST_YEAR to LAST_YEAR, and LEAST_BODY characters; texts end at MOST_BODY.
    """
    good = captures.where((F.col("status") == 200) & F.year("captured").between(FIRST_YEAR, LAST_YEAR) & (F.length("body") >= LEAST_BODY))
    first = good.groupBy("url").agg(F.min(F.struct("captured", "body")).alias("x"))
    return first.select("url", F.substring("x.body", 1, MOST_BODY).alias("text"), F.col("x.captured").alias("captured"))


def evaluation_corpus(spark: SparkSession, old: str, recent: str, web: str | None = None) -> DataFrame:
    """(doc_id, text, created, class) of JSON-lines files; the first record of an id is kept, old before recent before web."""
    out = None
    for rank, (path, name) in enumerate(((old, "old"), (recent, "recent"), (web, "web"))):
        if path:
            rows = spark.read.schema("doc_id string, text string, created string").json(path).select("doc_id", "text", dates.to_timestamp(F.col("created")).alias("created"), F.lit(name).alias("class"), F.lit(rank).alias("rank"))
            out = rows if out is None else out.unionByName(rows)
    kept = out.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("rank", "class", "created", "text")).alias("x"))
    return kept.select("doc_id", "x.text", "x.created", "x.class")
