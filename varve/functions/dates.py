"""Dates from text: one timestamp parser for all surfaces, and the claims that a document makes about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tried in this order after digit stamps and ISO 8601. (fixed values)
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "EEE, d MMM yyyy HH:mm:ss Z")
PAD = "00000101000000"
FIRST_YEAR, LAST_YEAR = 1990, 2100
SURFACE_CHARS = 20_000


def to_timestamp(value: Column) -> Column:
    """UTC timestamp of a date-like string, null if there is none.

    Strings of 4, 6, 8, 10, 12 or 14 digits are year, month, day, hour, minute, second as far as they go.
    """
    text = F.trim(value)
    digits = F.regexp_like(text, F.lit(r"^(\d{4}|\d{6}|\d{8}|\d{10}|\d{12}|\d{14})$"))
    padded = F.concat(text, F.substr(F.lit(PAD), F.length(text) + 1))
    iso = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"))
    named = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS if "EEE" not in f], F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.when(digits, F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss"))).when(iso, F.try_to_timestamp(text)).otherwise(named)


def claimed(value: Column) -> Column:
    """A claim is the string's own date, else the first ISO date in it, if its year is plausible."""
    inside = F.regexp_extract(value, r"\b((?:19[89]\d|20[0-4]\d)-\d{2}-\d{2})\b", 1)
    when = F.coalesce(to_timestamp(value), F.try_to_timestamp(F.nullif(inside, F.lit("")), F.lit("yyyy-MM-dd")))
    return F.when(F.year(when).between(FIRST_YEAR, LAST_YEAR), when)


#: Where and how a document states its date: surface -> (pattern, group of the date, group of the field name or 0), in the order
#: in which claims count; then the block of front matter and the fields in it, and script blocks of linked data. (fixed values)
SURFACES = {
    "meta": (r"""(?i)<meta[^>]+(?:name|property|itemprop)\s*=\s*["']?(date|dc\.date[\w.]*|article:published_time|article:modified_time|og:updated_time|pubdate|publish[-_]?date|datePublished|created)["']?[^>]*content\s*=\s*["']([^"']{4,40})["']""", 2, 1),
    "meta_reversed": (r"""(?i)<meta[^>]+content\s*=\s*["']([^"']{4,40})["'][^>]*(?:name|property|itemprop)\s*=\s*["']?(date|article:published_time|datePublished|pubdate)["']?""", 1, 2),
    "time": (r"""(?i)<time[^>]+datetime\s*=\s*["']([^"']{4,40})["']""", 1, 0),
    "jsonld": (r"""(?i)"(datePublished|dateCreated|dateModified|uploadDate)"\s*:\s*"([^"]{4,40})\"""", 2, 1),
    "prose": (r"""(?i)(?:published|posted|updated|written|created|first\s+appeared|last\s+modified)(?:\s+(?:on|at|in))?\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})""", 1, 0),
}
_LINKED = r"""(?is)<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
_FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
_FRONT_DATE = r"""(?im)^\s*(date|published|created|pubdate)\s*:\s*['"]?([^'"\n]{4,40})"""


#: What a field's claim is called. (fixed values)
_NAMES = {"meta": "meta:", "meta_reversed": "meta:", "time": "time.datetime", "jsonld": "jsonld:", "front_matter": "frontmatter:", "prose": "prose"}


def claims_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, surface, field, rank, claimed): every plausible date that a document states about itself, ranked in the order that claims count.

    Linked data is read in its script blocks only, front matter at the very start, all else in the first SURFACE_CHARS characters.
    """
    head = F.substring(F.col(text), 1, SURFACE_CHARS)
    front = F.regexp_extract(F.col(text), _FRONT, 1)
    linked = F.array_join(F.regexp_extract_all(head, F.lit(_LINKED), F.lit(1)), "\n")
    order = ["meta", "meta_reversed", "time", "jsonld", "front_matter", "prose"]

    def said(name: str) -> Column:
        pattern, group, named = (_FRONT_DATE, 2, 1) if name == "front_matter" else SURFACES[name]
        where = {"front_matter": front, "jsonld": linked}.get(name, head)
        values = F.regexp_extract_all(where, F.lit(pattern), F.lit(group))
        if not named:
            return F.transform(values, lambda d, i: F.struct(F.lit(name).alias("surface"), F.lit(_NAMES[name]).alias("field"), F.lit(order.index(name)).alias("part"), i.alias("at"), d.alias("said")))
        fields = F.regexp_extract_all(where, F.lit(pattern), F.lit(named))
        plain = (lambda f: f) if name == "jsonld" else F.lower
        return F.transform(values, lambda d, i: F.struct(F.lit(name).alias("surface"), F.concat(F.lit(_NAMES[name]), plain(F.get(fields, i))).alias("field"), F.lit(order.index(name)).alias("part"), i.alias("at"), d.alias("said")))

    found = docs.select(F.col(key), F.explode(F.concat(*[said(n) for n in order])).alias("x"))
    rank = (F.col("x.part") * 1_000_000 + F.col("x.at")).alias("rank")
    return found.select(key, "x.surface", "x.field", rank, claimed(F.col("x.said")).alias("claimed")).where("claimed is not null")


def claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, surface, claimed): every distinct plausible date that a document states about itself, by surface."""
    return claims_in_order(docs, key, text).select(key, "surface", "claimed").distinct()


def from_epoch(seconds: Column) -> Column:
    """UTC timestamp of seconds since 1970, whole or not."""
    return F.timestamp_micros((seconds.cast("double") * 1_000_000).cast("bigint"))


def wrap_claim(text: Column, claimed: Column, style: Column) -> Column:
    """A document that claims a date, in one of four styles (0 to 3): meta tag, front matter, prose, time tag."""
    day = F.date_format(claimed, "yyyy-MM-dd")
    return (
        F.when(style == 0, F.concat(F.lit('<meta name="date" content="'), day, F.lit('">\n'), text))
        .when(style == 1, F.concat(F.lit("---\ndate: "), day, F.lit("\n---\n"), text))
        .when(style == 2, F.concat(F.lit("Published on "), F.date_format(claimed, "MMMM d, yyyy"), F.lit("\n"), text))
        .otherwise(F.concat(F.lit('<time datetime="'), day, F.lit('"></time>\n'), text))
    )


def date_parts(parts: Column) -> Column:
    """Timestamp of [[year, month, day]], missing ones 1."""
    first = F.get(parts, F.lit(0))
    at = lambda i: F.coalesce(F.get(first, F.lit(i)), F.lit(1)).cast("int")
    return F.when(F.size(first) > 0, F.try_make_timestamp(F.get(first, F.lit(0)).cast("int"), at(1), at(2), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))
