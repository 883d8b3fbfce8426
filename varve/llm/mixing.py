"""Mixing to target weights with DataFrame functions only: soft domains, and document rates by projected gradient.

A classifier fitted on a labelled table gives each document posteriors over domains. Rates of documents are fitted so
that the expected tokens of each domain, sum of rate * tokens * posterior, meet the targets in least squares.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Posteriors are rounded to so many steps; documents with equal posteriors have equal rates.
STEPS = 500
_SPACE = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda w: w != "")


#: Document statistics as words of their own: share of bytes that are marks, share of capitals, share of distinct words.
_BINS = {"marks": (0.001, 0.004, 0.01, 0.02, 0.04, 0.08, 0.16), "capitals": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5), "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)}
_STATISTIC = "\u0001"


def _with_features(rows: DataFrame) -> DataFrame:
    """Adds features to rows with words and whole: distinct words, and for each statistic a word that tells its bin.

    Each statistic is a column before its bin is taken, or every edge of the bin would read the text again.
    """
    size = F.greatest(F.octet_length("whole"), F.lit(1))
    left = lambda pattern: F.octet_length(F.regexp_replace("whole", pattern, "")) / size
    rows = rows.withColumns({"unlike": F.array_distinct("words"), "s_marks": left("[^#$%&*!|<>{}=~^]+"), "s_capitals": left("[^A-Z]+")})
    rows = rows.withColumn("s_distinct", F.size("unlike") / F.greatest(F.size("words"), F.lit(1)))
    told = [F.concat(F.lit(f"{_STATISTIC}{name}"), sum((F.when(F.col(f"s_{name}") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string")) for name, edges in _BINS.items()]
    return rows.withColumn("features", F.concat("unlike", F.array(*told))).drop("unlike", *[f"s_{name}" for name in _BINS])


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: Sequence[str], *, key: str = "doc_id", text: str = "text", domain: str = "domain", max_rows: int = 10_000, vocabulary: int = 256, least_chi: float = 25.0
) -> dict:
    """Naive Bayes over distinct words and binned statistics: {"base": per-domain log prior, "words": {word: per-domain log odds}}.

    Learns from at most ``max_rows`` labelled documents, the first by a hash of their id, and keeps all statistics and the
    ``vocabulary`` words with the largest chi-square over domains, at least ``least_chi``. A document labelled twice counts under
    its smaller domain name; null ids, labels outside ``domains`` and labels without a document are left out. Without any,
    posteriors are uniform.
    """
    rows = labelled.where(F.col(key).isNotNull() & F.col(domain).isin(*domains)).groupBy(F.col(key).alias("key")).agg(F.min(domain).alias("domain"))
    rows = rows.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(max_rows)
    known = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("whole")).join(F.broadcast(rows), "key")
    seen = keep(_with_features(known.withColumn("words", _words("whole"))).select("domain", F.col("features").alias("words")))
    n = {r[0]: r[1] for r in seen.groupBy("domain").count().collect()}
    total = sum(n.values())
    if not total:
        return {"base": [0.0] * len(domains), "words": {}}
    by_word = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)])
    df = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    chi = F.lit(0.0)
    for k, d in enumerate(domains):
        expected = df * F.lit(n.get(d, 0) / total)
        chi = chi + F.when(expected > 0, (F.col(f"n{k}") - expected) ** 2 / expected).otherwise(0.0)
    told = F.startswith("word", F.lit(_STATISTIC))
    scored = by_word.withColumn("chi", F.when(told, 1e18).otherwise(F.round(chi, 6))).where((F.col("chi") >= least_chi) & (told | (df >= 5)))
    best = scored.orderBy(F.desc("chi"), "word").limit(vocabulary + sum(len(e) + 1 for e in _BINS.values())).collect()
    words = {}
    for r in best:
        p = [(r[f"n{k}"] + 0.5) / (n.get(d, 0) + 1) for k, d in enumerate(domains)]
        words[r["word"]] = [math.log(q) - math.log(max(p)) for q in p]
    return {"base": [math.log((n.get(d, 0) + 1) / (total + len(domains))) for d in domains], "words": words}


def log_odds(features: Column, model: dict) -> Column:
    """Per domain the log of its prior times that of each known word."""
    base = F.array(*[F.lit(float(b)) for b in model["base"]])
    if not model["words"]:
        return base
    change = F.from_json(F.lit(json.dumps(model["words"])), "map<string, array<double>>")
    present = F.array_intersect(features, F.array(*[F.lit(w) for w in model["words"]]))
    return F.aggregate(present, base, lambda s, w: F.zip_with(s, F.element_at(change, w), lambda x, y: x + y))


def _share(raised: str) -> Column:
    """Posteriors in whole steps that sum to STEPS; what rounding leaves goes to the largest."""
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    steps = F.transform(raised, lambda x: F.floor(x / total * STEPS).cast("int"))
    rest = F.lit(STEPS) - F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    top = F.array_position(raised, F.array_max(raised)).cast("int") - 1
    return F.transform(steps, lambda x, i: x + F.when(i == top, rest).otherwise(0))


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, key: str = "doc_id", text: str = "text", domain: str = "domain", anchor: str | None = None,
    keep_whole: Sequence[str] = (), most: float | None = None, rounds: int = 60, tolerance: float = 1e-4, columns: list[str] = (), **options,
) -> DataFrame:
    """Per row: key, n_tokens (words), p_<domain>, rate (>= 0), copies, miss, others.

    ``labelled`` has (key, domain); ``targets`` gives each domain's share of the expected tokens. The budget is the tokens of all
    documents, or with ``anchor`` such that this domain is taken just once. Rates minimise the sum over domains
    of the squared relative miss, subject to 0 <= rate <= ``most`` and rate >= 1 for documents whose likeliest domain is in
    ``keep_whole``. copies is rate rounded up or down by a hash of key and tokens, so its mean is rate. A domain that no
    document belongs to can't be met and gets no weight. Null and empty texts have 0 tokens and the posteriors of a text
    without any known word. Repeated rows and null keys each keep their row; an empty table gives no rows. ``miss`` is the
    same in all rows: the largest relative miss of a domain's target that is left after ``rounds``, above ``tolerance`` where
    the constraints can't meet the targets. ``others`` is a struct of ``columns`` under their own names, so they clash
    with no column of the result; it is absent if none are asked for.
    """
    names, k = list(targets), len(targets)
    carried = [F.struct(*[F.col(c) for c in columns]).alias("others")] if columns else []
    others = ["others"] if columns else []
    model = fit_domains(docs, labelled, names, key=key, text=text, domain=domain, **options)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), _words(text).alias("words"), whole.alias("whole"), *carried)
    rows = _with_features(rows).select("key", F.size("words").cast("bigint").alias("n"), log_odds(F.col("features"), model).alias("odds"), *others)
    # columns of their own: a lambda works out an expression that it holds anew for each element
    rows = rows.withColumn("top", F.array_max("odds"))
    rows = rows.withColumn("raised", F.transform("odds", lambda x: F.exp(x - F.col("top"))))
    base = keep(rows.withColumn("p", _share("raised")).drop("raised", "odds", "top"))
    # at most C(STEPS + k - 1, k - 1) distinct posteriors, whatever the input
    atoms = keep(base.groupBy("p").agg(F.sum("n").alias("n")))
    part = [F.sum(F.col("n") * F.col("p")[i] / STEPS) for i in range(k)]
    have = [float(x or 0) for x in atoms.agg(*[c.alias(f"x{i}") for i, c in enumerate(part)]).first()]
    total = sum(targets.values())
    budget = have[names.index(anchor)] / (targets[anchor] / total) if anchor else sum(have)
    want = [budget * targets[d] / total for d in names]
    likeliest = F.array_position("p", F.array_max("p")).cast("int") - 1
    floor = F.when(likeliest.isin(*[names.index(d) for d in keep_whole]), 1.0).otherwise(0.0) if keep_whole else F.lit(0.0)

    def rates(steps: list[list[float]]) -> Column:
        start = F.lit(1.0)
        if not steps:
            return start
        moves = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")

        def step(r: Column, g: Column) -> Column:
            moved = r - sum((F.col("p")[i] * g[i] for i in range(k)), F.lit(0.0)) / STEPS
            moved = F.greatest(moved, floor)
            return F.least(moved, F.lit(float(most))) if most is not None else moved

        return F.aggregate(moves, start, step)

    # in units of what a domain has, the largest eigenvalue of sum n p p' is at most 1: a unit step never overshoots
    steps: list[list[float]] = []
    got = have
    for _ in range(rounds if sum(have) else 0):
        miss = [(g - w) / h if h > 0 else 0.0 for g, w, h in zip(got, want, have)]
        if max(map(abs, miss)) <= tolerance:
            break
        steps.append(miss)
        weighed = atoms.withColumn("n", F.col("n") * rates(steps))
        before, got = got, [float(x or 0) for x in weighed.agg(*[c.alias(f"x{i}") for i, c in enumerate(part)]).first()]
        if max(abs(a - b) / h for a, b, h in zip(before, got, have) if h > 0) < tolerance / 100:
            break
    left = max([abs(g - w) / h for g, w, h in zip(got, want, have) if h > 0], default=0.0)
    out = base.withColumn("rate", F.round(rates(steps), 9))
    chance = F.pmod(F.xxhash64("key", "n", F.lit(77)), F.lit(1_000_003)) / 1_000_003
    copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_tokens"), *[(F.col("p")[i] / STEPS).alias(f"p_{d}") for i, d in enumerate(names)], "rate", copies.cast("bigint").alias("copies"), F.lit(round(left, 9)).alias("miss"), *others)


def label_domains(labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, domain) of a table with quality and toxic marks: toxic, else good or poor; null marks give no domain."""
    return labels.select(key, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))
