"""Command line: date, report, subset, fingerprint, sources, cache.

Run as ``python -m varve.plans.cli <command> …``, or with spark-submit. Exit codes: 0 done, 1 nothing to say, 2 bad input.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import export, report, sketch, verdict
from ..sources import cache, records, tables
from .engine import Engine

DONE, NOTHING, BAD = 0, 1, 2
_INDEPENDENT = "yes"


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("varve").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _documents(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path) if path.endswith((".jsonl", ".json")) else spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    for c in ("doc_id", "text", "url", "claimed"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("url"))
    return rows.withColumn("doc_id", key).withColumn("claimed", dates.to_timestamp(F.col("claimed").cast("string")))


def dated(spark: SparkSession, documents: str, witnesses: str | None, as_of: dt.datetime) -> DataFrame:
    """Verdicts of a file of documents; witnesses are a recorded table, and what the documents say of themselves."""
    docs = _documents(spark, documents)
    said = records.self_asserted(docs.select("doc_id", "text"), docs.select("doc_id", "claimed"))
    known = said if witnesses is None else spark.read.parquet(witnesses).withColumn("doc_id", F.col("doc_id").cast("string")).select(*said.columns).unionByName(said)
    profile = records.coverage_profile(records.registry_coverage(docs.select("doc_id", "url", "claimed")))
    targets = docs.select("doc_id", "claimed").join(profile, "doc_id", "left")
    return verdict.explain(Engine(as_of=as_of).date(targets, known))


def run(argv: Sequence[str], say=print) -> int:
    parser = argparse.ArgumentParser(prog="varve")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("date", "report", "subset"):
        p = sub.add_parser(name)
        p.add_argument("documents"), p.add_argument("--witnesses"), p.add_argument("--as-of", default="2026-01-01"), p.add_argument("--json", action="store_true")
        if name == "subset":
            p.add_argument("--max-synthetic", type=float, default=0.05), p.add_argument("--out")
    p = sub.add_parser("fingerprint")
    p.add_argument("documents"), p.add_argument("--show", action="store_true"), p.add_argument("--chars", type=int, default=2000)
    sub.add_parser("sources")
    p = sub.add_parser("cache")
    p.add_argument("folders", nargs="+")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return DONE if e.code == 0 else BAD
    missing = [f for f in ([args.documents] if hasattr(args, "documents") else []) if "://" not in f and not os.path.exists(f)]
    if missing:
        say(f"no such file: {missing[0]}")
        return BAD
    return COMMANDS[args.command](args, say)


def _date(args, say) -> int:
    rows = [r.asDict() for r in export.verdict_columns(dated(_spark(), args.documents, args.witnesses, dt.datetime.fromisoformat(args.as_of)), "").orderBy("doc_id").limit(1000).collect()]
    if args.json:
        for r in rows:
            say(json.dumps(r, default=str, ensure_ascii=False))
    else:
        say(export.text_table(rows, ["doc_id", "not_after", "human_origin_p", "ci_low", "ci_high", "abstained"]))
    return DONE if rows else NOTHING


def _report(args, say) -> int:
    rows = dated(_spark(), args.documents, args.witnesses, dt.datetime.fromisoformat(args.as_of))
    found = report.summary(rows).first()
    if found is None or not found["n"]:
        say("no documents")
        return NOTHING
    found = found.asDict()
    say(json.dumps(found, indent=2, default=str) if args.json else export.text_table([{"measure": k, "value": v} for k, v in found.items()], ["measure", "value"]))
    return DONE


def _subset(args, say) -> int:
    if not 0 < args.max_synthetic < 1:
        say("--max-synthetic is a share between 0 and 1")
        return BAD
    spark = _spark()
    plan = report.subset(dated(spark, args.documents, args.witnesses, dt.datetime.fromisoformat(args.as_of)), args.max_synthetic)
    chosen = export.subset_records(plan, _documents(spark, args.documents))
    n = chosen.count()
    if args.out:
        tables.write_jsonl(chosen, args.out)
    say(json.dumps({"max_synthetic": args.max_synthetic, "n_selected": n}))
    return DONE if n else NOTHING


def _fingerprint(args, say) -> int:
    docs = _documents(_spark(), args.documents).select("doc_id", "text")
    clean = text.normalise(docs)
    prints = sketch.fingerprints(clean).join(clean.select("doc_id", "flat"), "doc_id").orderBy("doc_id").limit(100).collect()
    for r in prints:
        say(f"{r.doc_id}  sha256={r.sha256}  tokens={r.n_tokens}")
        for c in sketch.WEIGHTS:
            say(f"  {c:6s} cardinality={r['n_' + c]:6d}")
        if args.show:
            say(r.flat[: args.chars])
    return DONE if prints else NOTHING


def _sources(args, say) -> int:
    rows = [{"source": s, "operator": o, "kind": k, "reliability": r, "forgeability": f, "evidence": "claim only" if k == "self_asserted" else _INDEPENDENT} for s, (o, k, r, f) in records.TRUST.items()]
    say(export.text_table(rows, ["source", "operator", "kind", "reliability", "forgeability", "evidence"]))
    return DONE


def _cache(args, say) -> int:
    spark, every = _spark(), None
    for k, folder in enumerate(args.folders):
        if not os.path.isdir(folder):
            say(f"no such folder: {folder}")
            return BAD
        layer = cache.scan(spark, folder, folder, k)
        every = layer if every is None else every.unionByName(layer)
    rows = [r.asDict() for r in cache.summary(every).orderBy("layer").collect()]
    say(export.text_table(rows, ["layer", "entries", "bytes"]))
    return DONE if rows else NOTHING


COMMANDS = {"date": _date, "report": _report, "subset": _subset, "fingerprint": _fingerprint, "sources": _sources, "cache": _cache}


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
