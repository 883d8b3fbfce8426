"""Flat rows for tables and files: rounded projections, annotation columns, and subsets with their original records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that an annotated table gets, in order. (fixed values)
COLUMNS = ("not_after", "not_after_year", "human_origin_p", "ci_low", "ci_high", "abstained", "operators", "evidence_logodds", "flags", "ancestor", "explanation")
#: Ratios from which a contradiction is severe. (fixed values)
SEVERE, MEDIUM = 4.0, 1.5


def iso(when: str | Column) -> Column:
    """ISO 8601 with the offset of UTC, as the session's time zone is."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def severity(log_lr: Column) -> Column:
    return F.when(log_lr >= SEVERE, "high").when(log_lr >= MEDIUM, "medium").otherwise("low")


def witness_rows(witnesses: DataFrame) -> DataFrame:
    return witnesses.select("doc_id", F.col("source_id").alias("source"), "operator", "kind", iso("observed_at").alias("observed_at"), F.bround("reliability", 4).alias("reliability"), F.bround("forgeability", 6).alias("forgeability"))


def bound_rows(bounds: DataFrame) -> DataFrame:
    when = [iso(c).alias(c) for c in ("not_after", "not_after_low", "not_after_high")]
    return bounds.select("doc_id", *when, "independent_operators", F.bround("effective_witnesses", 3).alias("effective_witnesses"), F.bround("forgery_logodds", 3).alias("forgery_logodds"))


def flag_rows(flags: DataFrame) -> DataFrame:
    return flags.select("doc_id", "kind", severity(F.col("log_lr")).alias("severity"), F.bround("log_lr", 3).alias("log_lr"), F.bround("coverage", 4).alias("coverage"))


def flags_of(flags: DataFrame) -> DataFrame:
    """(doc_id, flags, max_flag_log_lr): the kinds of each document's contradictions, sorted, and the strongest."""
    return flags.groupBy("doc_id").agg(F.array_sort(F.collect_list("kind")).alias("flags"), F.max("log_lr").alias("max_flag_log_lr"))


def _with_flags(verdicts: DataFrame, flags: DataFrame | None) -> DataFrame:
    if flags is None:
        return verdicts.withColumns({"flags": F.array().cast("array<string>"), "max_flag_log_lr": F.lit(0.0)})
    rows = verdicts.join(flags_of(flags), "doc_id", "left")
    return rows.withColumns({"flags": F.coalesce("flags", F.array().cast("array<string>")), "max_flag_log_lr": F.coalesce("max_flag_log_lr", F.lit(0.0))})


def _with_ancestors(rows: DataFrame, ancestors: DataFrame | None) -> DataFrame:
    if ancestors is None:
        return rows.withColumns({"ancestor": F.lit(None).cast("string"), "ancestor_relation": F.lit(None).cast("string")})
    return rows.join(ancestors.select("doc_id", F.col("r_id").cast("string").alias("ancestor"), F.col("relation").alias("ancestor_relation")), "doc_id", "left")


def verdict_rows(verdicts: DataFrame, flags: DataFrame | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """One flat row per verdict, rounded for tables."""
    rows = _with_ancestors(_with_flags(verdicts, flags), ancestors)
    return rows.select(
        "doc_id", iso("not_after").alias("not_after"), F.year("not_after").alias("not_after_year"), *[F.bround(c, 6).alias(c) for c in ("human_origin_p", "ci_low", "ci_high")], "abstained",
        "independent_operators", F.bround("strength", 3).alias("forgery_logodds"), "flags", F.bround("max_flag_log_lr", 3).alias("max_flag_log_lr"), "ancestor", "ancestor_relation",
    )


def verdict_columns(verdicts: DataFrame, prefix: str = "dated_", flags: DataFrame | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """(doc_id, <prefix> + COLUMNS) of verdicts, which need a column ``explanation``."""
    rows = _with_ancestors(_with_flags(verdicts, flags), ancestors)
    made = {
        "not_after": F.date_format("not_after", "yyyy-MM-dd"), "not_after_year": F.year("not_after"), "human_origin_p": F.bround("human_origin_p", 6), "ci_low": F.bround("ci_low", 6), "ci_high": F.bround("ci_high", 6),
        "abstained": F.col("abstained"), "operators": F.col("independent_operators"), "evidence_logodds": F.bround("strength", 4), "flags": F.col("flags"), "ancestor": F.col("ancestor"), "explanation": F.col("explanation"),
    }
    return rows.select("doc_id", *[made[c].alias(prefix + c) for c in COLUMNS])


def annotate(docs: DataFrame, columns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with the columns of its verdict, null where it has none. Columns of ``docs`` that clash are replaced."""
    own = [c for c in docs.columns if c == key or c not in columns.columns]
    return docs.select(*own).join(columns.withColumnRenamed("doc_id", key), key, "left")


def subset_records(plan: DataFrame, records: DataFrame, key: str = "doc_id") -> DataFrame:
    """The original records of a subset plan (doc_id, p), the likeliest first, ties by id: the plan's order. A plan's id without a record is left out."""
    rows = records.join(plan.select(F.col("doc_id").alias(key), F.col("p").alias("_p")), key)
    return rows.orderBy(F.desc("_p"), key).drop("_p")


def in_input_order(records: DataFrame, chosen: DataFrame, position: str, key: str = "doc_id") -> DataFrame:
    """The records of ``chosen`` (key and columns to attach), in the order of their ``position`` column."""
    return records.join(chosen, key).orderBy(position)


def first_of(rows: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row per key: the first by ``order``, or the last; a minimum of structs, so rows combine before the shuffle."""
    others = [c for c in rows.columns if c not in (key, order)]
    pick = (F.max if last else F.min)(F.struct(order, *others)).alias("x")
    return rows.groupBy(key).agg(pick).select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns])


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small table of collected rows as Markdown; floats to four places, null as a dash."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])


def text_table(rows: list[dict], columns: list[str]) -> str:
    """The same with columns padded to their widest value."""
    cells = [columns, *[["" if r.get(c) is None else str(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(row[k]) for row in cells) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, width)).rstrip() for row in cells)
