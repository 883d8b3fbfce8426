"""The engine: tables of targets and evidence in, verdicts and reports out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import text
from ..operators import align, flags, graph, report, sketch, verdict, witness


@dataclass(frozen=True)
class Engine:
    """Holds the settings; every method maps DataFrames to a DataFrame and runs nothing by itself."""

    consensus: witness.ConsensusConfig = field(default_factory=witness.ConsensusConfig)
    scoring: verdict.VerdictConfig = field(default_factory=verdict.VerdictConfig)
    alignment: align.AlignConfig = field(default_factory=align.AlignConfig)
    as_of: dt.datetime = dt.datetime(2026, 1, 1)

    def fingerprint(self, docs: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
        return sketch.fingerprints(text.normalise(docs, blocked=blocked))

    def index_archive(self, archive: DataFrame) -> DataFrame:
        """Fingerprints with not_after of (doc_id, text, not_after); rows without a date are dropped."""
        dated = archive.where("text is not null and not_after is not null")
        return self.fingerprint(dated.select("doc_id", "text")).join(dated.select("doc_id", "not_after"), "doc_id")

    def bounds(self, witnesses: DataFrame) -> DataFrame:
        return witness.consensus(witness.dedupe(witnesses), self.consensus)

    def contradictions(self, targets: DataFrame, witnesses: DataFrame, bounds: DataFrame) -> DataFrame:
        return flags.detect(targets, witness.dedupe(witnesses), bounds, self.as_of)

    def ancestors(self, prints: DataFrame, archive: DataFrame, null: DataFrame | None = None) -> DataFrame:
        return align.oldest_ancestor(align.matches(prints, archive, null, self.alignment))

    def date(self, targets: DataFrame, witnesses: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
        """Verdicts of all targets (doc_id, claimed, coverage); a target without witnesses keeps the base rate and abstains."""
        bounds = self.bounds(witnesses)
        found = self.contradictions(targets, witnesses, bounds)
        every = targets.select("doc_id").join(bounds, "doc_id", "left").fillna(0.0, ["forgery_logodds", "effective_witnesses"]).fillna(0, ["independent_operators"])
        return verdict.verdicts(every, flags.by_document(found), ancestors, self.scoring)

    def propagate(self, verdicts: DataFrame, edges: DataFrame) -> DataFrame:
        """Verdicts whose probability, interval and abstention follow from the derivation graph."""
        moved = graph.propagate(verdicts.selectExpr("doc_id", "human_origin_p as p"), edges)
        rows = verdicts.drop("ci_low", "ci_high").join(moved.select("doc_id", "p"), "doc_id")
        again = verdict.with_interval(rows, self.scoring)
        wide = again["ci_high"] - again["ci_low"] > self.scoring.abstain_width
        return again.withColumn("abstained", again["abstained"] | ((again["p"] < again["human_origin_p"]) & wide)).withColumn("human_origin_p", again["p"]).select(*verdicts.columns)

    def report(self, verdicts: DataFrame) -> DataFrame:
        return report.summary(verdicts)
