"""Recorded responses as tables: canonical keys, layers with overlays, replay, and fetching of what is missing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

#: Tokens of a host's bucket, and statuses that are worth another try. (fixed values)
BURST, RETRIED = 3, (429, 500, 502, 503, 504)
RESPONSE = "key string, status int, body string, fetched_at double"


def scan(spark: SparkSession, path: str, layer: str, priority: int = 0) -> DataFrame:
    """(key, status, body, fetched_at, layer, priority, bytes) of a folder of recorded responses, one JSON object a file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    at = lambda p: F.get_json_object("value", p)
    return raw.select(
        at("$.key").alias("key"), at("$.payload.status").cast("int").alias("status"), at("$.payload.body").alias("body"), at("$.fetched_at").cast("double").alias("fetched_at"),
        F.lit(layer).alias("layer"), F.lit(priority).alias("priority"), F.octet_length("value").cast("bigint").alias("bytes"),
    )


def overlay(*layers: DataFrame) -> DataFrame:
    """One response per key: that of the layer with the smallest priority, then the latest."""
    every = layers[0]
    for more in layers[1:]:
        every = every.unionByName(more)
    order = F.struct("priority", (-F.col("fetched_at")).alias("late"), "status", "body", "fetched_at", "layer", "bytes")
    return every.groupBy("key").agg(F.min(order).alias("x")).select("key", "x.status", "x.body", "x.fetched_at", "x.layer", "x.priority", "x.bytes")


def summary(layers: DataFrame) -> DataFrame:
    """(layer, entries, bytes)."""
    return layers.groupBy("layer").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


def replay(requests: DataFrame, cache: DataFrame, params: str | None = None) -> DataFrame:
    """The columns of ``requests`` (url, …) with key, status, body and ``miss``; a request that was not recorded is a miss, not an error."""
    key = urls.canonical_key(F.col("url"), F.col(params) if params else None)
    asked = requests.withColumn("key", key)
    return asked.join(cache.select("key", "status", "body"), "key", "left").withColumn("miss", F.col("status").isNull())


@dataclass
class Limiter:
    """A bucket of tokens per host; clock and sleep are given, so that tests need no time."""

    rate: float
    burst: int = BURST
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    buckets: dict = field(default_factory=dict)

    def take(self, host: str) -> float:
        """Waits until the host has a token; the seconds waited."""
        now = self.clock()
        tokens, at = self.buckets.get(host, (float(self.burst), now))
        tokens = min(float(self.burst), tokens + (now - at) * self.rate)
        wait = max(0.0, (1 - tokens) / self.rate)
        if wait:
            self.sleep(wait)
            tokens += wait * self.rate
        self.buckets[host] = (tokens - 1, now + wait)
        return wait


def attempt(get: Callable[[str], tuple[int, str, dict]], url: str, host: str, limiter: Limiter, tries: int = 3, backoff: float = 1.0) -> tuple[int, str]:
    """(status, body) after up to ``tries``; a wait that the server names is kept, else it doubles. Errors are status 0."""
    status, body, wait = 0, "", backoff
    for k in range(tries):
        limiter.take(host)
        try:
            status, body, headers = get(url)
        except OSError as e:
            status, body, headers = 0, str(e), {}
        if status and status not in RETRIED:
            break
        if k + 1 < tries:
            named = headers.get("Retry-After", "")
            limiter.sleep(float(named) if str(named).isdigit() else wait)
            wait *= 2
    return status, body


def fetch(requests: DataFrame, cache: DataFrame, get: Callable[[str], tuple[int, str, dict]], rate: float = 1.0, limiter: Callable[[float], Limiter] = Limiter, clock: Callable[[], float] = time.time) -> DataFrame:
    """New responses (key, status, body, fetched_at) of requests (url) that the cache lacks, each asked once.

    A host's requests meet in one task, which keeps its pace. Failures are rows too, so that they are not asked again. An
    ingestion step: write its result before it is queried. ``get`` is given; the library opens no connection by itself.
    """
    asked = requests.select(urls.canonical_key(F.col("url")).alias("key"), "url").groupBy("key").agg(F.min("url").alias("url"))
    missing = asked.join(cache.select("key"), "key", "left_anti").withColumn("host", urls.host(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = limiter(rate)
        for batch in batches:
            rows = [(k, *attempt(get, u, h, pace), clock()) for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "host")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.float64()))], ["key", "status", "body", "fetched_at"])

    return missing.repartition("host").sortWithinPartitions("host", "key").mapInArrow(run, RESPONSE)


def requested(key: Column) -> Column:
    """The host that a canonical key asks."""
    return urls.host(key)
