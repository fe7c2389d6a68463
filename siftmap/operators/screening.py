"""Screening prioritisation: votes, ranking, stopping point, recall curve, queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.plans.ordering import global_order


def majority_vote(labels: DataFrame, by=("doc_id", "split")) -> DataFrame:
    """Mean vote >= 0.5 per document and split; a tie counts as relevant."""
    return labels.groupBy(*by).agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))


def flag_labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    seen = labels.select("doc_id").distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, "doc_id", "left").withColumn("already_labelled", F.col("_seen").isNotNull()).drop("_seen")


def rank_predictions(scores: DataFrame, depth: int | None = None) -> DataFrame:
    """doc_id, p_relevant, priority_rank, expected_relevant_remaining, expected_total, corpus_size.

    Narrow on purpose: text columns join afterwards, so they never travel through the ranking.
    """
    o = global_order(scores, "p_relevant", "doc_id", sums=("p_relevant",), depth=depth)
    return o.select(
        "doc_id", "p_relevant",
        F.col("rank_no").alias("priority_rank"),
        (F.col("p_relevant_total") - F.col("p_relevant_running")).alias("expected_relevant_remaining"),
        F.col("p_relevant_total").alias("expected_total"),
        F.col("rows_total").alias("corpus_size"),
    )


def screening_predictions(scores: DataFrame, corpus: DataFrame, labels: DataFrame, depth: int | None = None) -> DataFrame:
    ranked = rank_predictions(scores.join(corpus.select("doc_id"), "doc_id", "left_semi").select("doc_id", "p_relevant"), depth)
    meta = corpus.select("doc_id", "title", "year", "region", "source_type", "language", "provenance")
    return flag_labelled(ranked.join(meta, "doc_id"), labels)


def stopping_point(ranked: DataFrame, fraction: float = 0.05) -> DataFrame:
    """First rank after which less than `fraction` of the expected relevant documents remain.

    Always one row; the rank is NULL when no row qualifies.
    """
    enough = F.col("expected_relevant_remaining") < fraction * F.col("expected_total")
    return ranked.agg(
        F.min(F.when(enough, F.col("priority_rank"))).alias("suggested_stop_rank"),
        F.max("expected_total").alias("expected_total_relevant"),
        F.count(F.lit(1)).alias("corpus_size"),
    )


def stopping_point_grouped(ranked: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Same, grouped by the total: no qualifying row gives no result row."""
    return (
        ranked.filter(F.col("expected_relevant_remaining") < fraction * F.col("expected_total"))
        .groupBy(F.col("expected_total").alias("expected_total_relevant"))
        .agg(F.min("priority_rank").alias("suggested_stop_rank"), F.max("corpus_size").alias("corpus_size"))
    )


def recall_curve(gold: DataFrame, scores: DataFrame, depth: int | None = None) -> DataFrame:
    """Recall after screening the top k documents, for every k."""
    judged = gold.select("doc_id", F.col("label").cast("bigint").alias("label")).join(scores.select("doc_id", "p_relevant"), "doc_id")
    o = global_order(judged, "p_relevant", "doc_id", sums=("label",), depth=depth)
    return o.select(
        F.col("row_no").alias("k"),
        F.col("rows_total").alias("n"),
        F.col("label_total").alias("n_rel"),
        F.try_divide(F.col("label_running").cast("double"), F.col("label_total").cast("double")).alias("recall_at_k"),
        (F.col("row_no") / F.col("rows_total")).alias("fraction_screened"),
    )


def work_saved(curve: DataFrame, recall: float = 0.95) -> DataFrame:
    return curve.filter(F.col("recall_at_k") >= recall).agg(
        (1 - F.min("fraction_screened")).alias("wss_at_95"), F.any_value("n").alias("test_size")
    )


def agreement(opinions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return opinions.agg(
        n.alias("n_band"),
        F.try_divide(F.count_if("agrees_with_model"), n).alias("llm_model_agreement"),
        F.try_divide(F.count_if(F.col("llm_decision") == "needs_full_text"), n).alias("needs_full_text_share"),
    )


def uncertain_band(predictions: DataFrame, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """Both ends included."""
    return predictions.filter(F.col("p_relevant").between(lo, hi) & ~F.col("already_labelled"))


def latest_decision(decisions: DataFrame, like: str = "screen_%") -> DataFrame:
    """Current decision per document; an aggregate, so a hot document is combined map-side."""
    return decisions.filter(F.col("decision_type").like(like)).groupBy("doc_id").agg(
        F.max_by("decision_type", F.struct("decided_at", "decision_id")).alias("human_decision")
    )


def queue_page(
    predictions: DataFrame, opinions: DataFrame, decisions: DataFrame,
    limit: int = 50, offset: int = 0, only_unlabelled: bool = True, region: str | None = None,
) -> DataFrame:
    """One page of the ranked queue with the second opinion and the current human decision.

    The page is cut before the joins: both enrichments hold at most one row per document, so
    they cannot change which rows the page has.
    """
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 1..200 and offset must not be negative")
    page = predictions
    if only_unlabelled:
        page = page.filter(~F.col("already_labelled"))
    if region:
        page = page.filter(F.col("region") == region)
    page = page.orderBy("priority_rank", "doc_id").offset(offset).limit(limit)
    ops = opinions.select("doc_id", "llm_decision", "criterion", "agrees_with_model", F.col("reason").alias("llm_reason"))
    human = latest_decision(decisions)
    return (
        page.join(ops, "doc_id", "left").join(human, "doc_id", "left")
        .select(
            "doc_id", "title", "year", "region", "source_type", "language", "provenance",
            F.round("p_relevant", 3).alias("p_relevant"), "priority_rank",
            "llm_decision", "criterion", "agrees_with_model", "llm_reason", "human_decision",
        )
        .orderBy("priority_rank", "doc_id")
    )


def validate_decisions(submitted: DataFrame, types: list[str]) -> DataFrame:
    """Every submitted row with the first rule it breaks; NULL means accepted."""
    rule = (
        F.when(F.col("doc_id").isNull() & F.col("cluster_id").isNull(), "doc_id or cluster_id required")
        .when(F.col("decision_type").isNull() | ~F.col("decision_type").isin(types), "unknown decision_type")
        .when(F.coalesce(F.length("reviewer"), F.lit(0)).between(1, 120) == F.lit(False), "reviewer must have 1 to 120 characters")
        .when(F.length("note") > 1000, "note longer than 1000 characters")
    )
    return submitted.withColumn("rejected_because", rule)
