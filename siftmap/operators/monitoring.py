"""Overrides, score drift and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Job kinds by the first pattern that matches the statement.
JOB_KINDS = [
    (r"ML\.GENERATE_TEXT", "llm_generate_text"),
    (r"ML\.GENERATE_EMBEDDING", "embedding"),
    (r"CREATE (OR REPLACE )?MODEL", "train_model"),
    (r"ML\.(PREDICT|FORECAST|EVALUATE)", "predict"),
    (r"VECTOR_SEARCH", "vector_search"),
]


def classify(text: str | Column, rules=JOB_KINDS, default: str = "other") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    out = None
    for pattern, kind in rules:
        out = F.when(text.rlike(pattern), kind) if out is None else out.when(text.rlike(pattern), kind)
    return out.otherwise(default)


def _cost(bytes_col: str, slot_col: str) -> list[Column]:
    return [
        (F.sum(bytes_col).cast("double") / F.lit(float(1024**3))).alias("gb_billed"),
        (F.sum(slot_col).cast("double") / F.lit(3.6e6)).alias("slot_hours"),
    ]


def cost_ledger(jobs: DataFrame, mentions: str, days: int = 30, until: Column | None = None) -> DataFrame:
    """Jobs, bytes and slot time per day and kind over the last `days` days.

    `until` defaults to the newest job, so a rerun over the same log gives the same ledger.
    """
    end = until if until is not None else jobs.agg(F.max("creation_time")).scalar()
    recent = jobs.filter((F.col("creation_time") >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & F.col("query").rlike(mentions))
    return recent.groupBy(F.to_date("creation_time").alias("day"), classify("query").alias("job_kind")).agg(
        F.count(F.lit(1)).alias("n_jobs"), *_cost("total_bytes_billed", "total_slot_ms")
    )


def run_cost(runs: DataFrame) -> DataFrame:
    return runs.groupBy("learning_type").agg(F.count(F.lit(1)).alias("n_runs"), *_cost("bytes_billed", "slot_ms"))


def contradicts(decision: str = "decision_type", p: str = "p_relevant") -> Column:
    return ((F.col(decision) == "screen_include") & (F.col(p) < 0.5)) | ((F.col(decision) == "screen_exclude") & (F.col(p) >= 0.5))


def override_rate(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """Share of screening decisions against the model. Every decision counts, not the latest only.

    Decisions are first counted per document and kind, so a document with very many decisions
    does not become a skewed join key.
    """
    per_doc = decisions.filter(F.col("decision_type").like("screen_%")).groupBy("doc_id", "decision_type").agg(F.count(F.lit(1)).alias("n"))
    met = per_doc.join(scores.select("doc_id", "p_relevant"), "doc_id")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return met.agg(F.try_divide(F.coalesce(F.sum(F.when(contradicts(), F.col("n"))), F.lit(0)), total).alias("override_rate"), total.alias("n_decisions"))


def histogram(scores: DataFrame) -> DataFrame:
    """Tenths of the score as integer buckets, so that no float is a key."""
    return scores.groupBy(F.floor(F.col("p_relevant") * 10).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def psi(scores: DataFrame, in_training: Column, floor: float = 1e-6, alert: float = 0.2) -> DataFrame:
    """Population stability index of all scores against the training-time ones.

    One scan counts both histograms; the rest works on at most eleven rows.
    """
    buckets = scores.groupBy(F.floor(F.col("p_relevant") * 10).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("a"), F.count_if(in_training).alias("e")
    )
    totals = buckets.agg(F.struct(F.sum("a").alias("a"), F.sum("e").alias("e")).alias("t")).scalar()
    share = lambda c, t: F.greatest(F.lit(floor), F.try_divide(F.col(c).cast("double"), F.col(f"t.{t}").cast("double")))
    a, e = share("a", "a"), share("e", "e")
    return buckets.withColumn("t", totals).agg(F.sum((a - e) * F.ln(a / e)).alias("psi")).select("psi", (F.col("psi") > alert).alias("drifted"))


def drift_alert(overrides: DataFrame, stability: DataFrame, max_override: float = 0.20, max_psi: float = 0.2) -> DataFrame:
    """One row with both measures and what to do."""
    return overrides.select("override_rate", stability.select("psi").scalar().alias("psi")).withColumn(
        "action", F.when((F.col("override_rate") > max_override) | (F.col("psi") > max_psi), "label more").otherwise("none")
    )
