"""Witnesses from recorded archive responses (doc_id, url, title, claimed, status, body), body a JSON or text column.

Each parser gives witness rows; ``collect`` unions those asked for. Fetching is not part of a query: responses are a table,
written by whatever crawls, and a source that could not answer has no row or another status than 200.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls

#: source -> (operator, kind, reliability, forgeability). (fixed values)
TRUST = {
    "wayback": ("internet-archive", "snapshot", 0.995, 1e-3),
    "commoncrawl": ("common-crawl", "snapshot", 0.99, 1e-3),
    "hackernews": ("hn", "posting", 0.99, 3e-3),
    "arxiv": ("arxiv", "registration", 0.999, 5e-4),
    "crossref-created": ("crossref", "registration", 0.99, 2e-3),
    "crossref-issued": ("crossref", "publication", 0.95, 5e-2),
    "git": ("local-git", "commit", 0.9, 0.5),
    "github-repo": ("github", "registration", 0.999, 1e-3),
    "github-commit": ("github", "commit", 0.97, 3e-2),
    "self": ("author", "self_asserted", 0.6, 0.98),
}
#: Witnesses kept per document. (fixed values)
CAPTURES, COLLECTED, CLAIMS = 6, 4, 6
TITLE_SHARE = 0.75


def _witness(rows: DataFrame, source: str, when: Column, field: Column | None = None, repo: Column | None = None, kind_of: str | None = None) -> DataFrame:
    operator, kind, reliability, forgeability = TRUST[kind_of or source]
    return rows.select(
        "doc_id", F.lit(source).alias("source_id"), F.lit(operator).alias("operator"), F.lit(kind).alias("kind"), when.alias("observed_at"), F.lit(reliability).alias("reliability"),
        F.lit(forgeability).alias("forgeability"), (F.lit(None) if field is None else field).cast("string").alias("field"), (F.lit(None) if repo is None else repo).cast("timestamp").alias("repo_created_at"),
    ).where("observed_at is not null")


def _first_k(rows: DataFrame, k: int, *order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def cdx_rows(responses: DataFrame) -> DataFrame:
    """(…, pos, row): rows of a capture index, a leading header row dropped."""
    body = F.from_json("body", "array<array<string>>")
    header = F.get(F.get(F.col("b"), F.lit(0)), F.lit(0)).isin("timestamp", "urlkey", "original")
    rows = responses.where("status = 200").withColumn("b", body).withColumn("b", F.when(F.coalesce(header, F.lit(False)), F.slice("b", 2, 1 << 30)).otherwise(F.when(F.size("b") >= 2, F.col("b"))))
    return rows.select("*", F.posexplode("b").alias("pos", "row")).drop("b", "body")


def wayback(responses: DataFrame) -> DataFrame:
    """The first captures of distinct content with a good status, at most CAPTURES."""
    rows = cdx_rows(responses).select("doc_id", "pos", dates.to_timestamp(F.get("row", F.lit(0))).alias("t"), F.coalesce(F.get("row", F.lit(2)), F.lit("")).alias("digest"), F.coalesce(F.get("row", F.lit(3)), F.lit("")).alias("status"))
    good = rows.where(F.col("status").isin("", "200", "-"))
    once = good.groupBy("doc_id", "digest").agg(F.min(F.struct("pos", "t")).alias("x")).select("doc_id", "x.pos", "x.t").where("t is not null")
    return _witness(_first_k(once, CAPTURES, "pos"), "wayback", F.col("t"))


def ndjson(responses: DataFrame) -> DataFrame:
    """(…, pos, rec): JSON objects of a line-delimited body; messages and broken lines dropped."""
    kind = "struct<urlkey:string,timestamp:string,url:string,status:string,digest:string,message:string>"
    rows = responses.where("status <> 404").select("*", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.startswith(F.ltrim("line"), F.lit("{")))
    return rows.withColumn("rec", F.from_json(F.trim("line"), kind)).where("rec is not null and rec.message is null").drop("line", "body")


def pick_collections(collections: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, collection): nearest in time to the claim (or 2019) and to a year later, then the most recent."""
    around = targets.select("doc_id", F.coalesce("claimed", F.to_timestamp(F.lit("2019-01-01"))).alias("t"))
    wants = around.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("t")), F.struct(F.lit(1).alias("n"), (F.col("t") + F.expr("INTERVAL 365 DAYS")).alias("t")))).alias("w"))
    table = F.broadcast(collections.agg(F.array_sort(F.collect_list(F.struct(F.col("started"), F.col("id")))).alias("all")))
    near = lambda t: F.array_min(F.transform("all", lambda c: F.struct(F.abs(F.unix_micros(c["started"]) - F.unix_micros(t)).alias("gap"), c["started"].alias("started"), c["id"].alias("id"))))["id"]
    nearest = wants.join(table).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("w.n").alias("n"), near(F.col("w.t")).alias("id")))), lambda x: x["id"]).alias("near"), F.first("all").alias("all"))
    recent = F.transform(F.reverse("all"), lambda c: c["id"])
    return nearest.select("doc_id", F.explode(F.slice(F.array_distinct(F.concat("near", recent)), 1, most)).alias("collection"))


def commoncrawl(responses: DataFrame) -> DataFrame:
    """At most three records per response, and COLLECTED per document."""
    per = ndjson(responses).where("rec.timestamp is not null")
    first = per.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "url").orderBy("pos"))).where("_n <= 3")
    rows = first.select("doc_id", "pos", "url", dates.to_timestamp(F.col("rec.timestamp")).alias("t")).where("t is not null")
    return _witness(_first_k(rows, COLLECTED, "url", "pos"), "commoncrawl", F.col("t"))


def host_coverage(responses: DataFrame, scale: float = 60.0, most: float = 0.95) -> DataFrame:
    """(doc_id, coverage) from distinct paths of the host in the index around the claim: 1 - exp(-n / scale)."""
    keys = cdx_rows(responses).select("doc_id", F.get("row", F.lit(0)).alias("urlkey"))
    return coverage_of(keys, scale, most)


def crawl_coverage(responses: DataFrame, scale: float = 40.0, most: float = 0.90) -> DataFrame:
    """(doc_id, coverage): the best of the collections asked."""
    keys = ndjson(responses).select("doc_id", F.col("url").alias("part"), F.col("rec.urlkey").alias("urlkey"))
    return coverage_of(keys, scale, most, ["part"]).groupBy("doc_id").agg(F.max("coverage").alias("coverage"))


def coverage_of(keys: DataFrame, scale: float, most: float, by: Sequence[str] = ()) -> DataFrame:
    n = keys.where("urlkey <> ''").groupBy("doc_id", *by).agg(F.count_distinct("urlkey").alias("n"))
    return n.select("doc_id", F.least(F.lit(most), 1 - F.exp(-F.col("n") / scale)).alias("coverage"))


def hackernews(responses: DataFrame) -> DataFrame:
    """The earliest posting whose URL equals the document's."""
    body = F.from_json("body", "struct<hits:array<struct<url:string,created_at:string,title:string>>>")
    hits = responses.where("status = 200").select("doc_id", "url", F.explode(body["hits"]).alias("h"))
    same = hits.where(urls.normalise(F.col("h.url")) == urls.normalise(F.col("url")))
    first = same.groupBy("doc_id").agg(F.min("h.created_at").alias("t"))
    return _witness(first, "hackernews", dates.to_timestamp(F.col("t")))


def _title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2))


def titles_match(a: Column, b: Column) -> Column:
    """At least TITLE_SHARE of the smaller title's words are common."""
    x, y = _title_words(a), _title_words(b)
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= F.lit(TITLE_SHARE) * F.least(F.size(x), F.size(y))), F.lit(False))


def arxiv(responses: DataFrame) -> DataFrame:
    """The first version's date of an Atom entry, by id or by a matching title; one per document."""
    entries = F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    at = lambda tag: F.trim(F.regexp_extract("e", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    rows = responses.where("status = 200").select("doc_id", "url", "title", F.posexplode(entries).alias("pos", "e"))
    rows = rows.select("doc_id", "pos", dates.to_timestamp(at("published")).alias("t"), (urls.arxiv_id(F.col("url")).isNotNull() | titles_match(F.col("title"), at("title"))).alias("ok"))
    return _witness(_first_k(rows.where("ok and t is not null"), 1, "pos"), "arxiv", F.col("t"))


def crossref(responses: DataFrame) -> DataFrame:
    """Two witnesses per matching record: its registration, and its publication."""
    kind = "struct<message:struct<items:array<struct<DOI:string,title:array<string>,created:struct<`date-time`:string>,issued:struct<`date-parts`:array<array<int>>>>>>>"
    items = responses.where("status = 200").select("doc_id", "url", "title", F.posexplode(F.from_json("body", kind)["message"]["items"]).alias("pos", "i"))
    asked = urls.doi(F.col("url"))
    ok = F.when(asked.isNotNull(), F.lower(asked) == F.lower("i.DOI")).otherwise(titles_match(F.col("title"), F.get("i.title", F.lit(0))))
    best = _first_k(items.where(ok), 1, "pos")
    created = _witness(best, "crossref", dates.to_timestamp(F.col("i.created.date-time")), F.lit("created"), kind_of="crossref-created")
    return created.unionByName(_witness(best, "crossref", dates.date_parts(F.col("i.issued.date-parts")), F.lit("issued"), kind_of="crossref-issued"))


def github(repositories: DataFrame) -> DataFrame:
    """From (doc_id, created_at, commits: array of dates): creation of the repository, and the earliest commit with it."""
    made = dates.to_timestamp(F.col("created_at"))
    first = F.array_min(F.transform("commits", dates.to_timestamp))
    return _witness(repositories, "github", made, F.lit("repo"), kind_of="github-repo").unionByName(_witness(repositories, "github", first, F.lit("commit"), made, "github-commit"))


def git_log(commits: DataFrame) -> DataFrame:
    """From (doc_id, author_date, committer_date): the earliest date of a path's history."""
    first = commits.groupBy("doc_id").agg(F.min(F.least(dates.to_timestamp(F.col("author_date")), dates.to_timestamp(F.col("committer_date")))).alias("t"))
    return _witness(first, "git", F.col("t"))


def self_asserted(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The document's own claims, distinct by field and day, at most CLAIMS: the target's first, then in the order that claims count."""
    said = dates.claims_in_order(docs).select("doc_id", "field", "rank", "claimed")
    if targets is not None:
        said = targets.where("claimed is not null").select("doc_id", F.lit("target.claimed_date").alias("field"), F.lit(-1).alias("rank"), "claimed").unionByName(said)
    once = said.groupBy("doc_id", "field", F.to_date("claimed").alias("day")).agg(F.min(F.struct("rank", F.col("claimed").alias("t"))).alias("x"))
    rows = once.select("doc_id", "field", "x.rank", "x.t")
    return _witness(_first_k(rows, CLAIMS, "rank", "t"), "self", F.col("t"), F.col("field"))


#: source -> whether it can say anything of a target (url, path, title, text, arxiv_id, doi); (fixed values)
SUPPORTS: dict[str, Callable[[], Column]] = {
    "wayback": lambda: F.col("url").isNotNull(),
    "commoncrawl": lambda: F.col("url").isNotNull(),
    "hackernews": lambda: F.col("url").isNotNull(),
    "arxiv": lambda: F.col("arxiv_id").isNotNull() | F.col("title").isNotNull(),
    "crossref": lambda: F.col("doi").isNotNull() | F.col("title").isNotNull(),
    "github": lambda: urls.repository(F.col("url"))["owner"] != "",
    "git": lambda: F.col("path").isNotNull(),
    "self": lambda: F.col("text").isNotNull(),
}


def described(targets: DataFrame) -> DataFrame:
    """Targets with every column that ``SUPPORTS`` reads: identifiers from the URL, a title guessed from the text."""
    rows = targets
    for c in ("url", "path", "title", "text"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    from ..functions import text as texts

    return rows.withColumns({"arxiv_id": urls.arxiv_id(F.col("url")), "doi": urls.doi(F.col("url")), "title": F.coalesce("title", texts.guess_title(F.col("text")))})


def applicable(targets: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, source): the sources to ask about each target."""
    chosen = list(names or SUPPORTS)
    rows = described(targets)
    asked = F.filter(F.array(*[F.when(SUPPORTS[n](), F.lit(n)) for n in chosen]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(asked).alias("source"))


def registry_coverage(targets: DataFrame) -> DataFrame:
    """(doc_id, source, coverage): what registries would know of a target (url, claimed) by its identifier and year. (fixed values)"""
    year, known = F.year("claimed"), described(targets)
    rules = {
        "arxiv": F.when(F.col("arxiv_id").isNotNull() & (year >= 1992), 0.98).otherwise(0.0),
        "crossref": F.when(F.col("doi").isNotNull() & (year >= 2000), 0.95).when(F.col("doi").isNotNull(), 0.4).otherwise(0.0),
        "self": F.lit(0.0),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("source"), c.cast("double").alias("coverage")) for n, c in rules.items()])
    return known.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.source", "x.coverage")


def host_year_coverage(captures: DataFrame, around: int = 1, scale: float = 60.0, most: float = 0.95, limit: int = 400) -> DataFrame:
    """(host, year, n, coverage): distinct paths of a host captured within ``around`` years, counted up to ``limit``, of rows (host, urlkey, year).

    One row per host and year, whatever the number of targets that ask for it.
    """
    near = captures.where("urlkey <> ''").select("host", "urlkey", F.explode(F.sequence(F.col("year") - around, F.col("year") + around)).alias("year"))
    n = near.groupBy("host", "year").agg(F.least(F.lit(limit).cast("bigint"), F.count_distinct("urlkey")).alias("n"))
    return n.withColumn("coverage", F.least(F.lit(most), 1 - F.exp(-F.col("n") / scale)))


def target_coverage(targets: DataFrame, memo: DataFrame, source: str = "wayback") -> DataFrame:
    """(doc_id, source, coverage) of targets (doc_id, url, claimed) by the memo of hosts and years; 0 where nothing was captured."""
    asked = targets.select("doc_id", urls.host(F.col("url")).alias("host"), F.year("claimed").alias("year"))
    return asked.join(memo.select("host", "year", "coverage"), ["host", "year"], "left").select("doc_id", F.lit(source).alias("source"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def coverage_profile(parts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, coverage: source -> coverage) of rows (doc_id, source, coverage); the best of a source counts, and a source that failed or is silent has 0.

    ``asked`` (doc_id, source) are the sources that apply, as of ``applicable``.
    """
    rows = parts.select("doc_id", "source", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    if asked is not None:
        rows = asked.join(rows, ["doc_id", "source"], "left").select("doc_id", "source", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    best = rows.groupBy("doc_id", "source").agg(F.max("coverage").alias("coverage"))
    return best.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "coverage")))).alias("coverage"))


#: name -> parser of recorded responses, in the order they are asked.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"wayback": wayback, "commoncrawl": commoncrawl, "hackernews": hackernews, "arxiv": arxiv, "crossref": crossref, "github": github, "git": git_log, "self": self_asserted}


def register(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    REGISTRY[name] = parser


def default_sources(names: Sequence[str] | None = None) -> list[str]:
    """The known sources in the order they are asked, or those named; an unknown name is an error that lists the known."""
    unknown = set(names or ()) - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}; known: {sorted(REGISTRY)}")
    return list(REGISTRY) if names is None else list(names)


def collect(tables: dict[str, DataFrame]) -> DataFrame:
    """All witnesses of the recorded tables by source name; unknown names are an error that lists the known."""
    unknown = set(tables) - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}; known: {sorted(REGISTRY)}")
    out = None
    for name, table in tables.items():
        found = REGISTRY[name](table)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no sources")
    return out
