"""Token counts: a map-side lookup in two tiers, without any shuffle of pre-tokens."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def frequent_lengths(docs: DataFrame, path: str, text: str, rows: int, row_bytes: int, size: int) -> bytes:
    """First tier, packed: lengths of the ``size`` most frequent pre-tokens of ``rows`` texts of at most ``row_bytes`` bytes.

    It only saves work: what it lacks is encoded where it is met, so no result depends on it.
    """
    specials, seen = pretoken.special_strings(path), Counter()
    for (t,) in docs.where(F.octet_length(text) <= row_bytes).select(text).limit(rows).collect():
        seen.update(pretoken.split(t, specials) or ())
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]
    encoded = [pretoken.tokenizer(path).encode(w, add_special_tokens=False).ids for w in words]
    lengths = " ".join(str(len(e)) for e in encoded)
    return zlib.compress("\n".join([lengths, *words]).encode())


def unpack(table: bytes) -> dict[str, int]:
    lengths, *words = zlib.decompress(table).decode().split("\n")
    return dict(zip(words, map(int, lengths.split())))


def count_tokens(
    docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", limit: int = 2048,
    sample_rows: int = 2000, sample_row_bytes: int = 16384, table_size: int = 50_000,
) -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens (no added special tokens), over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null keys each keep their row.
    Texts of any length are encoded whole. Special strings inside texts are handled as the library's
    default has it. Columns of ``docs`` other than key and text are neither read nor returned.
    """
    path = path or default_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(frequent_lengths(rows, path, "text", sample_rows, sample_row_bytes, table_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pretoken.Memo(path, len, unpack(table.value))
        specials, whole, length = pretoken.special_strings(path), pretoken.tokenizer(path).encode, memo.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column("text"):
                t = value.as_py() or ""
                words = pretoken.split(t, specials)
                n_bytes.append(len(t.encode()))
                n_tokens.append(len(whole(t, add_special_tokens=False).ids) if words is None else sum(map(length, words)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
