"""Registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.operators import registry as op
from siftmap.session import new_path

GATES = {"recall": 0.75, "roc_auc": 0.80}


def accepted(d):
    return op.accepted_promotions(d.promotion_requests(), d.models(), d.evaluations())


def stages(d):
    return op.model_stages(d.models(), accepted(d))


@query("registry_latest", """SELECT l_orderkey::VARCHAR AS run_id, l_returnflag AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def _(d):
    e = d.raw("lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_returnflag").alias("status"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return op.latest(e, "run_id", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], ["status"])


@query("registry_append", "SELECT run_id, dataset_id, status, started_at::DATE AS started_on FROM runs")
def _(d):
    """Run events appended in two batches, then read back."""
    path = new_path(d.spark, "training_runs")
    runs = d.runs().select("run_id", "dataset_id", "status", F.to_date("started_at").alias("started_on"))
    op.append(runs.filter("status = 'running'"), path)
    op.append(runs.filter("status <> 'running'"), path)
    return d.spark.read.schema(runs.schema).parquet(path)


@query("subquery_correlated_latest", """SELECT m.model_id, m.task, e.metrics_json FROM models m LEFT JOIN (
 SELECT model_id, metrics_json FROM evaluations QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY evaluated_at DESC, eval_id DESC) = 1) e ON e.model_id = m.model_id""")
def _(d):
    return op.latest_evaluation(d.models(), d.evaluations()).select("model_id", "task", "metrics_json")


MODELS = """SELECT m.model_id, m.run_id, m.task, m.learning_type, r.dataset_id, r.bytes_billed, r.slot_ms, e.metrics_json FROM models m LEFT JOIN runs r ON r.run_id = m.run_id LEFT JOIN (
 SELECT model_id, metrics_json FROM evaluations QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY evaluated_at DESC, eval_id DESC) = 1) e ON e.model_id = m.model_id"""


@query("models_list", MODELS + " ORDER BY m.created_at DESC, m.model_id")
def _(d):
    m = op.latest_evaluation(d.models(), d.evaluations())
    r = d.runs().select("run_id", "dataset_id", "bytes_billed", "slot_ms")
    return m.join(r, "run_id", "left").orderBy(F.desc("created_at"), "model_id").select(
        "model_id", "run_id", "task", "learning_type", "dataset_id", "bytes_billed", "slot_ms", "metrics_json"
    )


@query("runs_recent", """SELECT run_id, dataset_id, learning_type, status, bytes_billed, slot_ms, created_by FROM runs ORDER BY started_at DESC, run_id LIMIT 50""")
def _(d):
    return d.runs().drop("sql_text").orderBy(F.desc("started_at"), "run_id").limit(50).drop("started_at")


STAGE_RUNS = """SELECT run_id, learning_type AS stage, status FROM runs ORDER BY started_at DESC, run_id LIMIT 20"""


@query("stage_runs_recent", STAGE_RUNS)
@query("pipeline_runs_recent", STAGE_RUNS)
def _(d):
    return d.runs().orderBy(F.desc("started_at"), "run_id").limit(20).select("run_id", F.col("learning_type").alias("stage"), "status")


@query("tasks_list", """SELECT t.task_id, t.status, ds.name AS dataset_name, ds.version AS dataset_version FROM label_tasks t JOIN datasets ds ON ds.dataset_id = t.dataset_id ORDER BY t.created_seq DESC""")
def _(d):
    ds = d.datasets().select("dataset_id", F.col("name").alias("dataset_name"), F.col("version").alias("dataset_version"))
    return d.label_tasks().join(ds, "dataset_id").orderBy(F.desc("created_seq")).select("task_id", "status", "dataset_name", "dataset_version")


@query("registry_stage_counts", """SELECT 'model' AS kind, stage AS value, count(*) AS n FROM stages GROUP BY stage
UNION ALL SELECT 'run', status, count(*) FROM runs GROUP BY status UNION ALL SELECT 'task', status, count(*) FROM label_tasks WHERE status = 'open' GROUP BY status""")
def _(d):
    def count(df, kind, col):
        return df.groupBy(F.lit(kind).alias("kind"), F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    return (
        count(stages(d), "model", "stage").unionByName(count(d.runs(), "run", "status"))
        .unionByName(count(d.label_tasks().filter("status = 'open'"), "task", "status"))
    )


@query("model_promote", "SELECT model_id, task, stage FROM stages")
def _(d):
    return stages(d).select("model_id", "task", "stage")


@query("model_promotions_accepted", "SELECT promotion_id, model_id, task, to_stage, actor FROM promotions")
def _(d):
    return accepted(d).select("promotion_id", "model_id", "task", "to_stage", "actor")


@query("production_alias", "SELECT task, model_id, artifact, learning_type FROM stages WHERE stage = 'production'")
def _(d):
    return op.production(stages(d))


@query("quality_gate", """SELECT eval_id, CASE WHEN auc IS NULL THEN 1 ELSE 2 END AS n_known, (rec / 100.0::DOUBLE >= 0.75 AND coalesce(auc / 100.0::DOUBLE >= 0.80, true)) AS passed FROM evaluations""")
def _(d):
    return op.check_gates(d.evaluations(), GATES).select("eval_id", "n_known", "passed")
