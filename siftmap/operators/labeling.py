"""Labels from people and models: votes, gold set, queue, agreement, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWEST = ("labeled_at", "label_id")
# a row may be in several tasks; its labels in one say nothing about another
ITEM = ["task_id", "row_id"]


def model_labels(labels: DataFrame, floor: float | None = None) -> DataFrame:
    """The newest model label per task and row, all of its columns from one event."""
    m = labels.filter(F.col("source") == "llm")
    if floor is not None:
        m = m.filter(F.col("confidence") >= floor)
    newest = F.max_by(F.struct("label", "confidence", "rationale"), F.struct(*NEWEST))
    return m.groupBy(*ITEM).agg(newest.alias("m")).select(
        *ITEM, F.col("m.label").alias("llm_label"), F.col("m.confidence").alias("llm_conf"), F.col("m.rationale").alias("llm_rationale")
    )


def human_majority(labels: DataFrame) -> DataFrame:
    """Most voted label per task and row, ties to the smaller label. Votes are counted before rows meet."""
    votes = labels.filter(F.col("source") == "human").groupBy(*ITEM, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(*ITEM).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))


def gold(labels: DataFrame, floor: float = 0.9) -> DataFrame:
    """Human majority; rows without human labels take a model label of at least `floor` confidence."""
    human = human_majority(labels)
    model = model_labels(labels, floor).select(*ITEM, F.col("llm_label").alias("label")).join(human.select(*ITEM), ITEM, "left_anti")
    return human.withColumn("gold_source", F.lit("human")).unionByName(model.withColumn("gold_source", F.lit("llm")))


def pair_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: pairs of labels by two different annotators, and how many of them agree.

    Pairs are counted, never built. With n_a labels by annotator a and N in all, the pairs number
    (N^2 - sum of n_a^2) / 2; the same formula inside one label gives the pairs that agree. Labels
    are counted before the shuffle, so a group of any size arrives as a few numbers.
    """
    human = labels.filter(F.col("source") == "human")
    cells = human.groupBy(*keys, "label", "annotator").agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("n"))
    total, square = F.sum("n").cast("decimal(18,0)"), F.sum(F.col("n") * F.col("n")).cast("decimal(38,0)")
    pairs = ((F.col("t") * F.col("t") - F.col("sq")) / 2).cast("decimal(38,0)")

    same = cells.groupBy(*keys, "label").agg(total.alias("t"), square.alias("sq"))
    same = same.groupBy(*keys).agg(F.sum(pairs).cast("bigint").alias("n_agree"))
    every = cells.groupBy(*keys, "annotator").agg(total.alias("n"))
    every = every.groupBy(*keys).agg(total.alias("t"), square.alias("sq"))
    return every.select(*keys, pairs.cast("bigint").alias("n_pairs")).join(same, keys)


def agreement(labels: DataFrame) -> DataFrame:
    """Per task: agreement between annotators on the same row, and between human majority and model; one row per task with labels."""
    counted = pair_counts(labels, ITEM).groupBy("task_id").agg(F.sum("n_agree").alias("agree"), F.sum("n_pairs").alias("n_double_labelled"))
    model = model_labels(labels).join(human_majority(labels), ITEM).groupBy("task_id").agg(
        F.avg((F.col("label") == F.col("llm_label")).cast("double")).alias("human_llm_agreement")
    )
    return labels.select("task_id").distinct().join(counted, "task_id", "left").join(model, "task_id", "left").select(
        "task_id",
        F.try_divide(F.col("agree").cast("double"), F.col("n_double_labelled").cast("double")).alias("human_human_agreement"),
        F.coalesce("n_double_labelled", F.lit(0)).alias("n_double_labelled"),
        "human_llm_agreement",
    )


def queue(rows: DataFrame, labels: DataFrame, task: str, annotator: str, limit: int = 25) -> DataFrame:
    """What `annotator` should label next in `task`: fewest human labels, then the least certain model label.

    One aggregate over the labels answers all three questions (mine, model's, how many); rows
    without a model label count as least certain, and a hash breaks ties the same way each run.
    """
    human = F.col("source") == "human"
    newest = F.max_by(F.struct("label", "confidence", "rationale"), F.when(~human, F.struct(*NEWEST)))
    per_row = labels.filter(F.col("task_id") == task).groupBy("row_id").agg(
        F.count_if(human).alias("n_human"),
        F.coalesce(F.bool_or(human & (F.col("annotator") == annotator)), F.lit(False)).alias("mine"),
        F.bool_or(~human).alias("has_model"),
        newest.alias("m"),
    )
    out = rows.join(per_row, "row_id", "left").filter(~F.coalesce("mine", F.lit(False)))
    return (
        out.select(
            *rows.columns,
            F.when(F.col("has_model"), F.col("m.label")).alias("llm_label"),
            F.when(F.col("has_model"), F.col("m.confidence")).alias("llm_conf"),
            F.when(F.col("has_model"), F.col("m.rationale")).alias("llm_rationale"),
            F.coalesce("n_human", F.lit(0)).alias("n_human_labels"),
        )
        .orderBy("n_human_labels", F.abs(F.coalesce("llm_conf", F.lit(0.5)) - 0.5), F.md5("row_id"), "row_id")
        .limit(limit)
    )


def progress(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per task: rows of its dataset, and how many of them people and models have labelled."""
    human, model = F.col("source") == "human", F.col("source") == "llm"
    return labels.groupBy("task_id").agg(
        F.count_distinct(F.when(human, F.col("row_id"))).alias("n_human_rows"),
        F.count_distinct(F.when(model, F.col("row_id"))).alias("n_llm_rows"),
        F.count_distinct(F.when(human, F.col("annotator"))).alias("n_annotators"),
    ).select("task_id", rows.agg(F.count(F.lit(1))).scalar().alias("n_rows"), "n_human_rows", "n_llm_rows", "n_annotators")


def distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("task_id", "label", "source").agg(F.count(F.lit(1)).alias("n"))


def validate(labels: DataFrame, tasks: DataFrame, space: str = "label_space") -> DataFrame:
    """Adds `accepted`: the label is in the label space (a JSON array) of its task."""
    t = tasks.select("task_id", F.from_json(space, "array<string>").alias("_space"))
    # tasks are few and labels crowd on some of them; Spark broadcasts the side while it is small and splits hot tasks beyond
    return labels.join(t, "task_id", "left").withColumn(
        "accepted", F.coalesce(F.array_contains("_space", F.col("label")), F.lit(False))
    ).drop("_space")


def select_batch(candidates: DataFrame, k: int, rare_regions: Column, by: str = "title") -> DataFrame:
    """`k` rows to label next: uncertain first, then under-covered, then where model and second
    opinion disagree; of rows with the same normalised title only the best is taken.

    Needs row_id, p_relevant, llm_conf, llm_include, language, source_type and the title.
    """
    uncertain = (F.abs(F.col("p_relevant") - 0.5) <= 0.2) | (F.coalesce("llm_conf", F.lit(1.0)) <= 0.6)
    thin = rare_regions.cast("int") + (F.col("language") != "en").cast("int") + (F.col("source_type") != "peer_reviewed").cast("int")
    differs = F.coalesce((F.col("p_relevant") >= 0.5) != F.col("llm_include"), F.lit(False))
    order = F.struct(
        (~uncertain).cast("int").alias("not_uncertain"), (-thin).alias("coverage"), (~differs).cast("int").alias("agrees"),
        F.round(F.abs(F.col("p_relevant") - 0.5), 9).alias("margin"), F.col("row_id").alias("row_id"),
    )
    title = F.trim(F.regexp_replace(F.lower(by), r"[^a-z0-9]+", " "))
    best = candidates.select("row_id", title.alias("_t"), order.alias("o")).groupBy("_t").agg(F.min("o").alias("o"))
    ranked = best.orderBy("o").limit(k)
    return ranked.select("o.row_id", F.col("o.not_uncertain") == 0, (-F.col("o.coverage")), F.col("o.agrees") == 0).toDF(
        "row_id", "uncertain", "coverage_points", "disagreement"
    )
