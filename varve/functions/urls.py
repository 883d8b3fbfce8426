"""URLs as columns: hosts, comparison keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of tracking parameters. (fixed values)
TRACKING = ("utm_", "fbclid", "gclid", "ref")


def host(url: Column) -> Column:
    """Lower-case host with its port, empty if there is none."""
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def normalise(url: Column) -> Column:
    """Equal for URLs that differ in scheme, www., a slash at the end, the order of parameters, tracking or the fragment."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    way = F.rtrim(path(url), F.lit("/"))
    pairs = F.filter(F.split(query(url), "&"), lambda x: F.regexp_like(x, F.lit("^[^=]+=.+$")) & ~F.regexp_like(F.lower(x), F.lit("^(" + "|".join(TRACKING) + ")")))
    ordered = F.array_join(F.array_sort(pairs), "&")
    return F.concat(F.lit("//"), name, F.when(way == "", "/").otherwise(way), F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def canonical_key(url: Column, params: Column | None = None) -> Column:
    """One string per request: scheme and host in lower case, parameters (and those of a map) decoded, sorted and encoded anew."""
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda x: F.struct(decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.transform(F.filter(F.split(query(url), "&"), lambda x: x != ""), pair)
    if params is not None:
        given = F.transform(F.map_entries(F.coalesce(params, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        pairs = F.concat(pairs, given)
    ordered = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(host(url) == "", "").otherwise(F.concat(F.lit("//"), host(url))), path(url), F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def search_key(url: Column) -> Column:
    return F.rtrim(F.concat(F.regexp_replace(host(url), r"^www\.", ""), path(url)), F.lit("/"))


def arxiv_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/([a-z-]+/\d{7}|\d{4}\.\d{4,5})", 1), F.lit(""))


def doi(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1), F.lit(""))


def repository(url: Column) -> Column:
    """(owner, name, path) of a file or repository on the code host."""
    pattern = r"(?i)github\.com/([^/]+)/([^/?#]+)(?:/(?:blob|tree|raw)/[^/]+/([^?#]+))?"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("name"), F.regexp_extract(url, pattern, 3).alias("path"))
