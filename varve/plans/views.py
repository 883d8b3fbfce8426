"""The test tables seen as witnesses, targets, verdicts and edges; SQL has the same views for the oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flags, verdict, witness

AS_OF = dt.datetime(2026, 1, 1)
SHIFT_YEARS = 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when(column: str):
    return F.add_months(F.to_date(column), 12 * SHIFT_YEARS).cast("timestamp")


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item observes its order: suppliers are operators, flags give the kind."""
    kinds = {"RO": "snapshot", "RF": "registration", "AO": "commit", "AF": "publication", "NO": "citation", "NF": "self_asserted"}
    mark, kind = F.concat("l_returnflag", "l_linestatus"), F.lit(None).cast("string")
    for k, v in kinds.items():
        kind = F.when(mark == k, v).otherwise(kind)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("source_id"), F.concat(F.lit("op"), (F.col("l_suppkey") % 7).cast("string")).alias("operator"),
        kind.alias("kind"), _when("l_shipdate").alias("observed_at"), (F.lit(0.9) + F.col("l_discount")).alias("reliability"), (F.lit(1e-3) * (1 + F.col("l_linenumber"))).alias("forgeability"),
        F.lit(None).cast("string").alias("field"), F.floor("l_quantity").cast("int").alias("days"),
    )
    repo = F.date_add(F.to_date("observed_at"), F.col("days")).cast("timestamp")
    return rows.withColumn("repo_created_at", F.when(F.col("kind") == "commit", repo)).drop("days")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders claim their date; two sources cover them to degrees that follow from ids."""
    cover = F.create_map(F.lit("a"), (F.col("o_orderkey") % 10) / 10.0, F.lit("b"), (F.col("o_custkey") % 10) / 12.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _when("o_orderdate").alias("claimed"), cover.alias("coverage"))


def bounds(spark: SparkSession, sf_dir: str, cfg: witness.ConsensusConfig = witness.ConsensusConfig()) -> DataFrame:
    return witness.consensus(witnesses(spark, sf_dir), cfg)


def found_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.detect(targets(spark, sf_dir), witnesses(spark, sf_dir), bounds(spark, sf_dir), AS_OF)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all orders, those without witnesses included."""
    every = targets(spark, sf_dir).select("doc_id").join(bounds(spark, sf_dir), "doc_id", "left")
    every = every.fillna(0.0, ["forgery_logodds", "effective_witnesses"]).fillna(0, ["independent_operators"])
    return verdict.verdicts(every, flags.by_document(found_flags(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order derives from, or cites, orders with smaller ids."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dst"), "o_custkey")
    half = o.select(F.floor(F.col("dst") / 2).cast("bigint").alias("src"), "dst", F.when(F.col("o_custkey") % 3 == 0, "cites").otherwise("derived").alias("kind"), F.lit(1.0).alias("weight"))
    near = o.select((F.col("dst") - 1).alias("src"), "dst", F.lit("derived").alias("kind"), ((F.col("o_custkey") % 4) / 4.0).alias("weight"))
    return half.unionByName(near).where("src <> dst")


#: The same in DuckDB: w (witnesses), t (targets), run and b (bounds), fl (flags), v (probabilities).
W = """w as materialized (
  select l_orderkey as doc_id, 's' || (l_suppkey % 10) as source_id, 'op' || (l_suppkey % 7) as operator,
    case l_returnflag || l_linestatus when 'RO' then 'snapshot' when 'RF' then 'registration' when 'AO' then 'commit' when 'AF' then 'publication' when 'NO' then 'citation' when 'NF' then 'self_asserted' end as kind,
    (cast(l_shipdate as date) + interval 22 years)::timestamp as observed_at, 0.9 + l_discount as reliability, 0.001 * (1 + l_linenumber) as forgeability,
    case when l_returnflag || l_linestatus = 'AO' then ((cast(l_shipdate as date) + interval 22 years) + to_days(floor(l_quantity)::int))::timestamp end as repo_created_at
  from lineitem)"""
T = """t as materialized (
  select o_orderkey as doc_id, (cast(o_orderdate as date) + interval 22 years)::timestamp as claimed, (o_orderkey % 10) / 10.0::double as cov_a, (o_custkey % 10) / 12.0::double as cov_b from orders)"""
#: Support of each time by a triangular join, unlike the windows of the engine.
RUN = """times as (select distinct doc_id, observed_at as t from w where kind <> 'self_asserted'),
grp as (
  select x.doc_id, x.t, w.operator, min(forgeability) as f, sum(ln(greatest(1e-9, 1 - reliability))) as slip, count(*) as n
  from times x join w on w.doc_id = x.doc_id and w.observed_at <= x.t and kind <> 'self_asserted' group by all),
run as materialized (
  select doc_id, t, sum(ln(greatest(1e-300, least(1.0, f + (1 - f) * exp(slip))))) as log_p, count(*) as operators, sum(1 + (n - 1) * 0.15) as ess from grp group by doc_id, t)"""


def bound_sql(alpha: float = 1e-2) -> str:
    return f"""hit as (
  select doc_id, min(t) filter (where log_p <= ln({alpha}) + 1e-12) as na, min(t) filter (where log_p <= ln(0.05) + 1e-12) as low, min(t) filter (where log_p <= ln(0.0001) + 1e-12) as high, max(t) as last
  from run group by doc_id),
b as materialized (
  select h.doc_id, coalesce(na, last) as not_after, coalesce(low, na, last) as not_after_low, coalesce(high, last) as not_after_high, r.operators as independent_operators,
    r.ess as effective_witnesses, least(-r.log_p, -ln(1e-300)) as forgery_logodds, case when na is null then 'best-effort-below-alpha' else 'weighted-order-statistic' end as method
  from hit h join run r on r.doc_id = h.doc_id and r.t = coalesce(na, last)
  union all
  select doc_id, null, null, null, 0, 0.0, 0.0, 'no-independent-evidence' from w group by doc_id having count(*) filter (where kind <> 'self_asserted') = 0)"""


FLAGS = """ops as (select doc_id, operator, min(observed_at) filter (where kind <> 'self_asserted') as seen, min(observed_at) filter (where kind = 'self_asserted') as said from w group by all),
facts as (select doc_id, min(seen) as seen, max(seen) as latest, count(seen) as n_ops, min(said) as said from ops group by all),
j as materialized (
  select t.doc_id, coalesce(t.claimed, f.said) as c, f.seen, f.latest, f.n_ops, b.not_after, b.independent_operators,
    (case when cov_a > 0.05 then -ln(greatest(1e-6, 1 - cov_a)) else 0 end) + (case when cov_b > 0.05 then -ln(greatest(1e-6, 1 - cov_b)) else 0 end) as silence,
    greatest(case when cov_a > 0.05 then cov_a else 0 end, case when cov_b > 0.05 then cov_b else 0 end) as cover,
    (case when cov_a > 0.05 then 1 else 0 end) + (case when cov_b > 0.05 then 1 else 0 end) as n_cover
  from t left join facts f using (doc_id) left join b using (doc_id)),
fl as materialized (
  select doc_id, 'backdate' as kind, greatest(silence, 0) + least(1.0, date_diff('day', c, seen) / 3650.0) as log_lr, cover as coverage, n_cover as n_sources from j where date_diff('day', c, seen) > 365 and greatest(silence, 0) + least(1.0, date_diff('day', c, seen) / 3650.0) > 0.5
  union all select doc_id, 'backdate', silence, cover, n_cover from j where seen is null and n_cover > 0 and date_diff('day', c, timestamp '2026-01-01') > 730
  union all select doc_id, 'postdate', 1.0, 0.0, 0 from j where date_diff('day', seen, c) > 365
  union all select distinct on (w.doc_id, w.observed_at, w.repo_created_at, w.source_id, w.operator) w.doc_id, 'commit_predates_repo', 5.0, 1.0, 1 from w join t using (doc_id) where kind = 'commit' and date_diff('day', observed_at, repo_created_at) > 30
  union all select doc_id, 'operator_disagreement', 0.6, 0.0, n_ops from j where n_ops >= 2 and date_diff('day', seen, latest) > 1095
  union all select doc_id, 'single_operator', 0.0, 0.0, 1 from j where not_after is not null and independent_operators = 1)"""


def probability_sql(mid: float = 2023.4, steep: float = 1.35, floor: float = 0.004, ceiling: float = 0.45) -> str:
    year = "(year(not_after) + (epoch_us(not_after) - epoch_us(date_trunc('year', not_after)))::double / (epoch_us(date_trunc('year', not_after) + interval 1 year) - epoch_us(date_trunc('year', not_after))))"
    return f"""
  select t.doc_id, b.not_after, round(coalesce(b.forgery_logodds, 0), 9) as strength, coalesce(b.independent_operators, 0) as independent_operators, coalesce(f.pen, 0) as pen, coalesce(f.n, 0) as n_flags,
    case when coalesce(b.forgery_logodds, 0) > 0 then exp(-round(b.forgery_logodds, 9)) else 1.0 end as fail,
    case when b.not_after is null then 1 - {ceiling} else 1 - ({floor} + ({ceiling} - {floor}) / (1 + exp(-{steep} * ({year} - {mid})))) end as human, 1 - {ceiling} as base
  from t left join b using (doc_id) left join (select doc_id, sum(log_lr) filter (where kind in ('backdate', 'commit_predates_repo')) as pen, count(*) as n from fl group by doc_id) f using (doc_id)"""


def verdict_sql(name: str = "v", **curve: float) -> str:
    return f"""{name}0 as ({probability_sql(**curve)}),
{name}1 as (select *, (1 - fail) * human + fail * base as m from {name}0),
{name} as materialized (
  select doc_id, not_after, strength, independent_operators, n_flags,
    round(least(greatest(case when pen > 0 then 1 / (1 + exp(-(ln(least(greatest(m, 1e-12), 1 - 1e-12) / (1 - least(greatest(m, 1e-12), 1 - 1e-12))) - pen))) else m end, 1e-6), 1 - 1e-6), 9) as p
  from {name}1)"""


#: Quantiles of the Beta by the same midpoint rule, one row per cell.
INTERVAL = """pairs as materialized (select distinct p, strength, 2.5 * (1 + greatest(0, strength)) as k from v),
cells as (
  select p, strength, i, p * k * ln((i + 0.5) / 1000) + (1 - p) * k * ln(1 - (i + 0.5) / 1000) as lw from pairs, range(1000) r(i)),
weights as (select p, strength, i, exp(lw - max(lw) over (partition by p, strength)) as x from cells),
sums as (select *, sum(x) over (partition by p, strength order by i) as c, sum(x) over (partition by p, strength) as s from weights),
ci as materialized (
  select p, strength, min(i + (0.05 * s - (c - x)) / x) filter (where c >= 0.05 * s and c - x < 0.05 * s) / 1000 as ci_low,
    min(i + (0.95 * s - (c - x)) / x) filter (where c >= 0.95 * s and c - x < 0.95 * s) / 1000 as ci_high
  from sums group by all),
u as materialized (
  select v.*, ci_low, ci_high, (ci_high - ci_low > 0.34 or not_after is null) as abstained from v join ci using (p, strength))"""

BASE = ",\n".join((W, T, RUN, bound_sql(), FLAGS, verdict_sql()))
FULL = BASE + ",\n" + INTERVAL
