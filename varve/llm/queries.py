"""Thin queries over the test tables: each applies one operator to a whole table and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding, media, mixing, neardup, packing, quality, sharding, substring, tokens
from .common import text_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    kinds = dict(turns.dtypes)
    more = spark.range(2, numPartitions=1).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said
    )
    done = chat.format_chats(turns.unionByName(more))
    back = done.withColumn("back", chat.read_back(F.col("formatted")))
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: chat.unescape(x["text"], chat.Template())), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid_order",
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicate_passages(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), "cluster_id", F.crc32(F.col("clean").cast("binary")).alias("clean_crc32"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Shares of the expected tokens by domain.
TARGETS = {"good": 0.9, "poor": 0.05, "toxic": 0.05}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = media.media_columns(table(spark, sf_dir, "documents"))
    codes = F.array_join(F.transform("codes", lambda c: c.cast("string")), " ")
    return done.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), F.sha2(codes.cast("binary"), 256)).alias("feature"),
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_media_columns": op10_media_columns,
}

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({}, '~', '~0'), '<s>', '~1'), '</s>', '~2'), '[INST]', '~3'), '[/INST]', '~4'), '[TURN]', '~5'), '[/TURN]', '~6'), '<|endoftext|>', '~7')"

ORACLES = {
    "op2_chat_formatting": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), stepped as (
  select *, lag(role, 1, '') over (partition by conv_id order by turn, role, text) as before,
    lead(role) over (partition by conv_id order by turn, role, text) is null as is_last,
    length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 24 as written
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(written)::bigint as formatted_chars,
  bool_and((before || '>' || role) in ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') and (not is_last or role = 'assistant')) as valid_order
from stepped group by conv_id""",
    "op5_embedding_near_dedup": """
with recursive v as materialized (
  select vec_id, label, embedding::double[] as e from embeddings
), fine as materialized (
  select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), both_ways as materialized (select a, b from links union all select b, a from links),
reach(v, u) as (select vec_id, vec_id from embeddings union select r.v, e.b from reach r join both_ways e on e.a = r.u)
select v.vec_id, (select count(*) from both_ways e where e.a = v.vec_id) as n_links, m.component_id, v.vec_id = m.component_id as kept
from embeddings v join (select v as vec_id, min(u) as component_id from reach group by v) m using (vec_id)""",
    "op8_minhash_near_dedup": """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), sets as materialized (
  select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), items as materialized (select doc_id, unnest(s) as x from sets),
common as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by all
), links as materialized (
  select a, b from common join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), both_ways as materialized (select a, b from links union all select b, a from links),
reach(v, u) as (select doc_id, doc_id from documents union select r.v, e.b from reach r join both_ways e on e.a = r.u)
select s.doc_id, len(s.s) as n_shingles, m.component_id, s.doc_id = m.component_id as kept
from sets s join (select v, min(u) as component_id from reach group by v) m on m.v = s.doc_id""",
}
