"""Models, runs and promotions as event tables: the current state is the latest event per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stages a model may be in.
STAGES = ["candidate", "staging", "production", "retired"]


def append(df: DataFrame, path: str) -> None:
    """Registry tables only grow; a retried append is harmless as readers keep one event per id."""
    df.write.mode("append").parquet(path)


def latest(events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The newest event per key, combined map-side."""
    return events.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("s")).select(key, "s.*")


def latest_evaluation(models: DataFrame, evaluations: DataFrame) -> DataFrame:
    newest = latest(evaluations, "model_id", ["evaluated_at", "eval_id"], ["metrics_json"])
    return models.join(newest, "model_id", "left")


def accepted_promotions(requests: DataFrame, models: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Requests that follow the rules: a known model and stage, a written reason, and for staging
    and production an evaluation made before the request."""
    first = evaluations.groupBy("model_id").agg(F.min("evaluated_at").alias("_first"))
    ok = F.col("to_stage").isin("candidate", "retired") | (F.col("_first") <= F.col("promoted_at"))
    return (
        requests.filter(F.col("to_stage").isin(STAGES) & (F.trim("reason") != ""))
        .join(models.select("model_id", "task"), "model_id")
        .join(first, "model_id", "left")
        .filter(ok)
        .drop("_first")
    )


def model_stages(models: DataFrame, accepted: DataFrame) -> DataFrame:
    """The stage of every model after all accepted promotions.

    A model has the stage of its last promotion, except that a later promotion of another model
    to production in the same task has moved it from production back to staging.
    """
    when = F.struct("promoted_at", "promotion_id")
    last = accepted.groupBy("model_id").agg(F.max_by("to_stage", when).alias("to_stage"))
    holder = accepted.filter(F.col("to_stage") == "production").groupBy("task").agg(F.max_by("model_id", when).alias("_holder"))
    return (
        models.join(last, "model_id", "left").join(holder, "task", "left")
        .withColumn(
            "stage",
            F.when(F.col("to_stage").isNull(), "candidate")
            .when((F.col("to_stage") == "production") & (F.col("_holder") != F.col("model_id")), "staging")
            .otherwise(F.col("to_stage")),
        )
        .drop("to_stage", "_holder")
    )


def production(stages: DataFrame) -> DataFrame:
    return stages.filter(F.col("stage") == "production").select("task", "model_id", "artifact", "learning_type")


def check_gates(evaluations: DataFrame, gates: dict[str, float]) -> DataFrame:
    """`passed` per evaluation, from a JSON object of metrics.

    A gate named `<metric>_max` is an upper bound, any other a lower bound. Metrics that are
    missing are ignored, but at least one must be present. Without gates `passed` is NULL.
    """
    metrics = F.from_json("metrics_json", "map<string,double>")
    if not gates:
        return evaluations.select("*", F.lit(None).cast("boolean").alias("passed"), F.lit(0).alias("n_known"))
    checks = []
    for name, bound in gates.items():
        value = F.get(F.array(F.element_at("_m", name.removesuffix("_max"))), 0)
        checks.append(value <= bound if name.endswith("_max") else value >= bound)
    known = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return (
        evaluations.withColumn("_m", metrics)
        .withColumn("_k", F.coalesce(known, F.array().cast("array<boolean>")))
        .withColumn("n_known", F.size("_k"))
        .withColumn("passed", (F.col("n_known") > 0) & F.forall("_k", lambda c: c))
        .drop("_m", "_k")
    )
