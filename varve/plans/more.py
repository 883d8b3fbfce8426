"""Queries for sources, exports and evaluation over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import align, calibrate, evaluate, export, report, sketch, verdict
from ..sources import cache, harvest, records
from . import views
from .queries import _SCORED, _TOKENS, _scored, _tokens, query
from .views import table

# ---------------------------------------------------------------- calibration and evaluation


@query(f"""with {_SCORED}, k as (select round(p, 2) as x, avg(label) as y, count(*) as n from sc group by 1),
c as (select x, row_number() over (order by x) as i, sum(n * y) over (order by x) as s, sum(n) over (order by x) as m, n, y from k),
e as (select a.i as j, b.i as k, (b.s - a.s + a.n * a.y) / (b.m - a.m + a.n) as v from c a join c b on b.i >= a.i),
l as (select c.i, e.j, min(e.v) as v from c join e on e.j <= c.i and e.k >= c.i group by all)
select c.x, round(least(greatest(max(l.v), 1e-4), 1 - 1e-4), 6) as calibrated from c join l using (i) group by c.x""")
def isotonic_calibration(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("p", F.round("p", 2))
    points = rows.select(F.col("p").alias("x")).distinct()
    return calibrate.fit(rows, places=2).apply(points, "x").select("x", F.round("calibrated", 6).alias("calibrated"))


@query(f"""with {_SCORED}, k as (select least(greatest(p, 1e-6), 1 - 1e-6) as q, label from sc), z as (select ln(q / (1 - q)) as z, label as y from k),
m as (select covar_pop(z, y) / var_pop(z) as a, avg(y) - covar_pop(z, y) / var_pop(z) * avg(z) as b from z)
select doc_id, round(least(greatest(a * ln(greatest(least(p, 1 - 1e-12), 1e-12) / (1 - greatest(least(p, 1 - 1e-12), 1e-12))) + b, 1e-4), 1 - 1e-4), 5) as calibrated from sc, m""")
def linear_calibration(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return calibrate.fit(rows, isotonic=False, places=15).apply(rows).select("doc_id", F.round("calibrated", 5).alias("calibrated"))


_DRAWN = "('0x' || substr(md5('{seed}:' || {key}), 1, 12))::bigint / 16.0::double ** 12"


@query(f"""with n as (select doc_id, {_DRAWN.format(seed=3, key="doc_id")} as n from documents)
select doc_id, case when n < 0.4 then 'train' when n < 0.6 then 'calibrate' else 'test' end as split from n""")
def splits(spark, sf_dir):
    return evaluate.split(table(spark, sf_dir, "documents").select("doc_id"), {"train": 0.4, "calibrate": 0.2, "test": 0.4}, seed=3)


@query(f"""with n as (select doc_id, row_number() over (order by {_DRAWN.format(seed=5, key="doc_id")}, doc_id) as r from documents)
select doc_id, case when r <= 50 then 'archive' when r <= 80 then 'query' when r <= 120 then 'reference' end as role from n""")
def roles(spark, sf_dir):
    return evaluate.roles(table(spark, sf_dir, "documents").select("doc_id"), {"archive": 50, "query": 30, "reference": 40}, seed=5)


@query(f"""with {views.BASE}, h as (select distinct doc_id from fl where kind in ('backdate', 'commit_predates_repo'))
select o_orderpriority, count(*) as n, round(avg((h.doc_id is not null)::int), 6) as flag_rate from orders left join h on h.doc_id = o_orderkey group by 1""")
def backdate_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    return evaluate.backdate_rate(docs, views.found_flags(spark, sf_dir), ["o_orderpriority"]).withColumn("flag_rate", F.round("flag_rate", 6))


@query("""with r as (select l_returnflag as variant, (l_suppkey % 5)::varchar as channel, l_linenumber % 3 as k, l_discount as c, l_linestatus = 'O' as same from lineitem)
select variant, channel, round(avg(c) filter (where k = 0), 6) as reflow, round(avg(c) filter (where k = 1), 6) as matched, round(avg(c) filter (where k = 2), 6) as random, round(avg(same::int) filter (where k = 0), 6) as hash_hit,
  round(avg(c) filter (where k = 1) - avg(c) filter (where k = 2), 6) as separation from r group by all""")
def ablation(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "reflow").when(F.col("l_linenumber") % 3 == 1, "matched").otherwise("random")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), (F.col("l_suppkey") % 5).cast("string").alias("channel"), kind.alias("kind"), F.col("l_discount").alias("containment"), (F.col("l_linestatus") == "O").alias("same"))
    done = evaluate.ablation(rows)
    return done.select("variant", "channel", *[F.round(c, 6).alias(c) for c in ("reflow", "matched", "random", "hash_hit", "separation")])


@query("""select o_orderpriority, count(*) as n, round(avg((o_custkey % 3 = 0 and o_orderkey // 2 = o_orderkey - 1 or o_custkey % 3 <> 0)::int), 6) as recall from orders group by 1""")
def ancestor_recall(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    truth = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") - 1).alias("source_id"), "o_orderpriority")
    found = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 3 == 0, F.floor(F.col("o_orderkey") / 2).cast("bigint")).otherwise(F.col("o_orderkey") - 1).alias("r_id"))
    return evaluate.ancestor_recall(found, truth, ["o_orderpriority"]).withColumn("recall", F.round("recall", 6))


@query(f"""with {_SCORED}, m as (select avg(p) filter (where label = 1) as hl, avg(p) filter (where label = 0) as sl, avg(confidence) filter (where label = 1) as hb, avg(confidence) filter (where label = 0) as sb from sc)
select round(hl, 6) as human_logloss, round(sl, 6) as synthetic_logloss, round(abs(sl - hl), 6) as logloss_gap, round(hb, 6) as human_burstiness, round(sb, 6) as synthetic_burstiness, round(abs(sb - hb), 6) as burstiness_gap from m""")
def detectability_gap(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("doc_id", F.col("p").alias("logloss"), F.col("confidence").alias("burstiness"), (F.col("label") == 1).alias("human"))
    done = evaluate.detectability_gap(rows)
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query("""with r as (select (l_suppkey % 5)::varchar as method, l_linenumber % 2 = 0 as seen, l_returnflag <> 'R' as fam, l_discount as auc from lineitem)
select method, round(avg(auc) filter (where fam and seen), 6) as auc_seen, round(avg(auc) filter (where fam and not seen), 6) as auc_unseen, round(avg(auc) filter (where not fam), 6) as auc_other_family,
  round(avg(auc) filter (where fam and seen) - avg(auc) filter (where fam and not seen), 6) as drop_unseen, round(avg(auc) filter (where fam and seen) - avg(auc) filter (where not fam), 6) as drop_family from r group by 1""")
def headline(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("method"), (F.col("l_linenumber") % 2 == 0).alias("seen"), (F.col("l_returnflag") != "R").alias("same_family"), F.col("l_discount").alias("auc"))
    done = evaluate.headline(rows)
    return done.select("method", *[F.round(c, 6).alias(c) for c in done.columns if c != "method"])


@query("""select (l_suppkey % 5)::varchar as stage, sum(l_linenumber)::bigint as n, round(sum(l_tax), 4) as seconds, round(sum(l_tax) / sum(l_linenumber), 6) as seconds_per_document,
  round(sum(l_orderkey % 5) / (sum(l_orderkey % 5) + sum(l_partkey % 3)), 6) as hit_rate from lineitem group by 1""")
def costs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("stage"), F.col("l_tax").alias("seconds"), F.col("l_linenumber").alias("documents"), (F.col("l_orderkey") % 5).alias("hits"), (F.col("l_partkey") % 3).alias("misses"))
    return evaluate.costs(rows).select("stage", "n", F.round("seconds", 4).alias("seconds"), F.round("seconds_per_document", 6).alias("seconds_per_document"), F.round("hit_rate", 6).alias("hit_rate"))


@query("select lang, source, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from documents group by lang, source")
def corpus_shares(spark, sf_dir):
    return evaluate.shares(table(spark, sf_dir, "documents"), "lang", "source").withColumn("share", F.round("share", 9))


# ---------------------------------------------------------------- exports


@query(f"""with {views.FULL}, g as (select doc_id, array_to_string(list_sort(list(kind)), ',') as flags from fl group by 1)
select u.doc_id, strftime(not_after, '%Y-%m-%d') as x_not_after, year(not_after)::int as x_not_after_year, round_even(p, 6) as x_human_origin_p, abstained as x_abstained,
  independent_operators::bigint as x_operators, round_even(strength, 4) as x_evidence_logodds, coalesce(flags, '') as x_flags, null::varchar as x_ancestor, o_orderstatus from u join orders on o_orderkey = u.doc_id left join g on g.doc_id = u.doc_id""")
def annotated_table(spark, sf_dir):
    rows = views.verdicts(spark, sf_dir)
    columns = export.verdict_columns(verdict.explain(rows), "x_", views.found_flags(spark, sf_dir)).drop("x_explanation", "x_ci_low", "x_ci_high")
    columns = columns.withColumns({"x_flags": F.array_join("x_flags", ","), "x_operators": F.col("x_operators").cast("bigint")})
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    return export.annotate(docs, columns)


@query(f"""with {views.BASE} select doc_id, kind, case when log_lr >= 4 then 'high' when log_lr >= 1.5 then 'medium' else 'low' end as severity, round_even(log_lr, 3) as log_lr, round_even(coverage, 4) as coverage from fl""")
def flag_rows(spark, sf_dir):
    return export.flag_rows(views.found_flags(spark, sf_dir))


@query(f"""with {views.BASE} select doc_id, strftime(not_after, '%Y-%m-%dT%H:%M:%S+00:00') as not_after, independent_operators::bigint as independent_operators, round(effective_witnesses, 3) as effective_witnesses, round(forgery_logodds, 3) as forgery_logodds from b""")
def bound_rows(spark, sf_dir):
    return export.bound_rows(views.bounds(spark, sf_dir)).select("doc_id", "not_after", F.col("independent_operators").cast("bigint").alias("independent_operators"), "effective_witnesses", "forgery_logodds")


@query(f"""with {views.BASE}, ranked as (select round(p, 6) as q, doc_id, row_number() over (order by round(p, 6) desc, doc_id) as k from v), s as (select *, sum((1 - q) - 0.05) over (order by k) as s from ranked),
m as (select max(k) filter (where s <= 1e-9) as k from s) select o.o_orderkey as doc_id, o_orderstatus, o_custkey from s join m on s.k <= m.k join orders o on o.o_orderkey = s.doc_id""")
def subset_records(spark, sf_dir):
    plan = report.subset(views.verdicts(spark, sf_dir), 0.05)
    return export.subset_records(plan, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_custkey"))


@query("""select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order from orders group by 1""")
def first_and_last(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey")
    last = export.first_of(rows, "o_custkey", "at", last=True).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return last.join(export.first_of(rows, "o_custkey", "at").select("o_custkey", F.col("o_orderkey").alias("first_order")), "o_custkey")


# ---------------------------------------------------------------- text and alignment


@query(r"""with l as (select doc_id, list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^#+\s*', '')) as l from documents)
select doc_id, list_filter(l, lambda x: length(x) between 12 and 240 and len(string_split_regex(x, '\s+')) >= 3)[1] as title from l""")
def guessed_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.guess_title(F.col("text")).alias("title"))


_A, _B = sketch.coefficients(sketch.WINDOW_SLOTS, 2)
_WMIN = ", ".join(f"min((h * {a} + {b}) % {sketch.PRIME})" for a, b in zip(_A, _B))
_WBANDS = ", ".join(f"m[{2 * k + 1}] || ',' || m[{2 * k + 2}]" for k in range(32))


@query(f"""with {_TOKENS}, s as (select doc_id, w, len(w) as n, case when len(w) = 0 then [] when len(w) <= 128 then [0] else list_sort(list_distinct(list_concat(range(0, len(w) - 127, 64), [len(w) - 128]))) end as s from tok),
x as (select doc_id, n, w, unnest(s) as start from s), p as materialized (select doc_id, start, w[start + 1:least(n, start + 128)] as w from x),
sh as (select doc_id, start, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from p),
h as materialized (select distinct doc_id, start, ('0x' || substr(md5(g), 1, 7))::bigint as h from sh),
m as (select doc_id, start, [{_WMIN}] as m from h group by all), b as (select doc_id, generate_subscripts([{_WBANDS}], 1) as band, unnest([{_WBANDS}]) as key from m),
k as materialized (select doc_id, band, key, count(*) as n from b group by all)
select a.doc_id as q_id, c.doc_id as r_id, sum(a.n * c.n)::bigint as hits from k a join k c on a.band = c.band and a.key = c.key and a.doc_id < c.doc_id group by all""")
def window_collisions(spark, sf_dir):
    windows = sketch.window_sketches(_tokens(spark, sf_dir).select("doc_id", F.col("w").alias("tokens")))
    keys = align.window_keys(windows)
    both = keys.withColumnsRenamed({"doc_id": "q_id", "n": "q_n"}).join(keys.withColumnsRenamed({"doc_id": "r_id", "n": "r_n"}), ["band", "key"]).where("q_id < r_id")
    return both.groupBy("q_id", "r_id").agg(F.sum(F.col("q_n") * F.col("r_n")).alias("hits"))


@query("select min(timestamp '2001-09-09 01:46:40' + to_seconds(doc_id * 3600)) filter (where doc_id % 3 > 0) as oldest, count(*) filter (where doc_id % 3 > 0) as n_dated from documents")
def oldest_time(spark, sf_dir):
    when = F.when(F.col("doc_id") % 3 > 0, F.timestamp_seconds(F.lit(1_000_000_000) + F.col("doc_id") * 3600))
    return align.oldest_time(table(spark, sf_dir, "documents").select(when.alias("not_after")))


# ---------------------------------------------------------------- sources


@query(r"""with u as (select page_id, trim(url) as url from pages), x as (select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as s, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as h,
  regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)', 1) as p, list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> ''),
  lambda q: {'k': regexp_extract(q, '^([^=]*)', 1), 'v': regexp_extract(q, '^[^=]*=(.*)$', 1)})) as q from u)
select page_id, case when s = '' then '' else s || ':' end || case when h = '' then '' else '//' || h end || p || case when len(q) = 0 then '' else '?' || array_to_string(list_transform(q, lambda e: e.k || '=' || e.v), '&') end as key from x""")
def canonical_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_key(F.col("url")).alias("key"))


def _layers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("k"), F.col("page_id").cast("string")).alias("key"), "page_id", F.length("html").alias("n"))
    layer = lambda rows, name, rank, status: rows.select("key", status.cast("int").alias("status"), F.concat(F.lit(f"{name} "), F.col("key")).alias("body"), F.lit(1.0).alias("fetched_at"), F.lit(name).alias("layer"), F.lit(rank).alias("priority"), F.col("n").cast("bigint").alias("bytes"))
    return layer(p.where("page_id % 2 = 0"), "root", 0, F.lit(200)), layer(p.where("page_id % 3 = 0"), "fixtures", 1, F.lit(404))


@query("""select 'k' || page_id as key, case when page_id % 2 = 0 then 200 else 404 end::int as status, case when page_id % 2 = 0 then 'root k' else 'fixtures k' end || page_id as body from pages where page_id % 2 = 0 or page_id % 3 = 0""")
def cache_overlay(spark, sf_dir):
    return cache.overlay(*_layers(spark, sf_dir)).select("key", "status", "body")


@query("""select 'root' as layer, count(*) as entries, sum(length(html))::bigint as bytes from pages where page_id % 2 = 0 union all select 'fixtures', count(*), sum(length(html))::bigint from pages where page_id % 3 = 0""")
def cache_summary(spark, sf_dir):
    root, fixtures = _layers(spark, sf_dir)
    return cache.summary(root.unionByName(fixtures))


@query("""select page_id, page_id % 2 <> 0 as miss from pages""")
def replayed_requests(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.format_string("HTTP://Archive.Example/get?b=%d&a=x", "page_id").alias("url"))
    recorded = p.where("page_id % 2 = 0").select(F.format_string("http://archive.example/get?a=x&b=%d", "page_id").alias("key"), F.lit(200).alias("status"), F.lit("{}").alias("body"))
    return cache.replay(p, recorded).select("page_id", "miss")


def _responses(spark, sf_dir) -> dict[str, DataFrame]:
    """Recorded bodies in every source's format, made from pages: capture k of page i is in month 1 + k of year 2000 + i mod 20."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.format_string("https://example.org/p/%d", "page_id").alias("url"), F.format_string("A long title of page number%d here", "page_id").alias("title"), (2000 + F.col("page_id") % 20).alias("y"))
    row = lambda k: F.format_string(f'["%d{k + 1:02d}15000000","u","d{k % 3}","{(200, 404, 200, 200)[k]}"]', "y")
    cdx = F.concat(F.lit('[["timestamp","original","digest","statuscode"],'), F.concat_ws(",", *[row(k) for k in range(4)]), F.lit("]"))
    line = lambda k: F.format_string(f'{{"urlkey":"k{k}","timestamp":"%d{k + 2:02d}01000000","status":"200"}}', "y")
    nd = F.concat_ws("\n", line(0), F.lit('{"message":"none"}'), line(1), F.lit("broken"))
    hits = F.format_string('{"hits":[{"url":"http://www.example.org/p/%d/","created_at":"%d-03-04T05:06:07Z","title":"t"},{"url":"http://other.org","created_at":"1999-01-01T00:00:00Z","title":"t"}]}', "doc_id", "y")
    atom = F.format_string("<feed><entry><title>Something else entirely</title><published>1998-01-01T00:00:00Z</published></entry><entry><title>A Long Title of Page number%d HERE</title><published>%d-05-06T00:00:00Z</published></entry></feed>", "doc_id", "y")
    works = F.format_string('{"message":{"items":[{"DOI":"10.1/x","title":["A long title of page number%d here"],"created":{"date-time":"%d-07-08T00:00:00Z"},"issued":{"date-parts":[[%d,6]]}}]}}', "doc_id", "y", "y")
    ok = lambda body: p.select("doc_id", "url", "title", F.lit(200).alias("status"), body.alias("body"))
    said = F.format_string('<script type="application/ld+json">{"a":{"datePublished":"%d-09-10"}}</script> "dateCreated":"1997-01-01" <meta name="date" content="%d-11-12">\nPublished on %d-11-12', "y", "y", "y")
    return {
        "wayback": ok(cdx), "commoncrawl": ok(nd), "hackernews": ok(hits), "arxiv": ok(atom), "crossref": ok(works),
        "github": p.select("doc_id", F.format_string("%d-02-03T00:00:00Z", "y").alias("created_at"), F.array(F.format_string("%d-01-02T00:00:00Z", "y"), F.format_string("%d-12-02T00:00:00Z", "y")).alias("commits")),
        "git": p.select("doc_id", F.format_string("%d-08-09T00:00:00Z", "y").alias("author_date"), F.format_string("%d-08-07T00:00:00Z", "y").alias("committer_date")),
        "self": p.select("doc_id", said.alias("text")),
    }


_RECORDED = {
    "wayback": [("snapshot", "01-15", ""), ("snapshot", "03-15", "")], "commoncrawl": [("snapshot", "02-01", ""), ("snapshot", "03-01", "")], "hackernews": [("posting", "03-04", "")], "arxiv": [("registration", "05-06", "")],
    "crossref": [("registration", "07-08", "created"), ("publication", "06-01", "issued")], "github": [("registration", "02-03", "repo"), ("commit", "01-02", "commit")], "git": [("commit", "08-07", "")],
    "self": [("self_asserted", "11-12", "meta:date"), ("self_asserted", "09-10", "jsonld:datePublished"), ("self_asserted", "11-12", "prose")],
}


@query("with e(source_id, kind, day, field) as (values " + ", ".join(f"('{s}', '{k}', '{d}', '{f}')" for s, found in _RECORDED.items() for k, d, f in found) + """)
select page_id as doc_id, source_id, kind, (2000 + page_id % 20) || '-' || day as observed_at, field from pages, e""")
def recorded_witnesses(spark, sf_dir):
    found = records.collect(_responses(spark, sf_dir))
    return found.select("doc_id", "source_id", "kind", F.date_format("observed_at", "yyyy-MM-dd").alias("observed_at"), F.coalesce("field", F.lit("")).alias("field"))


@query("""select page_id as doc_id, unnest(case page_id % 3 when 0 then ['wayback', 'commoncrawl', 'hackernews', 'arxiv', 'crossref', 'self'] when 1 then ['wayback', 'commoncrawl', 'hackernews', 'github', 'git'] else ['wayback', 'commoncrawl', 'hackernews', 'crossref'] end) as source from pages""")
def applicable_sources(spark, sf_dir):
    k = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.when(k == 1, "https://github.com/some/thing").when(k == 2, "https://example.org/10.1234/ab.5").otherwise("https://example.org/x").alias("url"),
        F.when(k == 1, "src/a.py").alias("path"), F.when(k == 0, "## A title of several words\nand its text").alias("text"),
    )
    return records.applicable(rows)


@query(r"""with k as (select lower(regexp_extract(trim(url), '//([^/?#]*)', 1)) as host, url, 2010 + page_id % 8 as y from pages), e as (select host, url, unnest([y - 1, y, y + 1]) as year from k),
m as (select host, year, least(400, count(distinct url)) as n from e group by all),
t as (select page_id as doc_id, lower(regexp_extract(trim(url), '//([^/?#]*)', 1)) as host, 2008 + page_id % 12 as year from pages)
select doc_id, round(case when n is null then 0 else least(0.95, 1 - exp(-n / 60.0)) end, 6) as wayback, 0.0::double as arxiv, case when doc_id % 2 = 0 then case when year >= 2000 then 0.95 else 0.4 end else 0.0 end::double as crossref from t left join m using (host, year)""")
def coverage_profiles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    captured = p.select(urls.host(F.col("url")).alias("host"), F.col("url").alias("urlkey"), (2010 + F.col("page_id") % 8).cast("int").alias("year"))
    claimed = F.make_timestamp((2008 + F.col("page_id") % 12).cast("int"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    targets = p.select(F.col("page_id").alias("doc_id"), "url", claimed.alias("claimed"))
    known = targets.withColumn("url", F.when(F.col("doc_id") % 2 == 0, F.lit("https://x.org/10.5555/abc")).otherwise(F.lit("https://x.org/y")))
    parts = records.target_coverage(targets, records.host_year_coverage(captured)).unionByName(records.registry_coverage(known))
    profile = records.coverage_profile(parts)
    return profile.select("doc_id", F.round(F.col("coverage")["wayback"], 6).alias("wayback"), F.col("coverage")["arxiv"].alias("arxiv"), F.col("coverage")["crossref"].alias("crossref"))


@query(r"""with w as (select doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as n from documents where text not like '%<%' and text not like '%&%')
select 'r' || doc_id as doc_id, case when 2010 + doc_id % 15 < 2021 then 'old' else 'recent' end as era, n::int as n from w where n >= 90""")
def harvested_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text not like '%<%' and text not like '%&%'")
    body = F.concat(F.lit("<OAI><record><id>r"), F.col("doc_id").cast("string"), F.lit("</id><created>"), (2010 + F.col("doc_id") % 15).cast("string"), F.lit("-02-03</created><title>t</title><abstract>"), F.coalesce("text", F.lit("")), F.lit("</abstract></record></OAI>"))
    return harvest.oai_records(d.select(F.lit(200).alias("status"), body.alias("body"))).select("doc_id", "era", harvest.words(F.col("text")).alias("n"))


@query("""with c as (select url, html, 2010 + page_id % 14 as y, page_id from pages where length(html) >= 800 and page_id % 5 <> 0 and 2010 + page_id % 14 between 2015 and 2020),
f as (select url, arg_min({'h': html, 'y': y}, (y, html)) as x from c group by url) select url, x.y::int as year, length(substr(x.h, 1, 120000))::int as n from f""")
def seed_captures(spark, sf_dir):
    when = F.make_timestamp((2010 + F.col("page_id") % 14).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"), F.col("html").alias("body"), when.alias("captured"))
    return harvest.seed_pages(rows).select("url", F.year("captured").alias("year"), F.length("text").alias("n"))
