"""Monitoring and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.operators import monitoring as op

# a reviewer's choice set against the score's side of a half; anything but include or exclude can't be an override
OVERRIDE = """SELECT avg(differs) AS override_rate, count(*) AS n_decisions FROM (
 SELECT CASE decision_type WHEN 'screen_include' THEN p_relevant < 0.5 WHEN 'screen_exclude' THEN p_relevant >= 0.5 ELSE false END::INTEGER::DOUBLE AS differs
 FROM decisions JOIN scores USING (doc_id) WHERE starts_with(decision_type, 'screen_'))"""
PSI = """SELECT sum((a - e) * ln(a / e)) AS psi FROM (
 SELECT greatest(1e-6::DOUBLE, count(*) / sum(count(*)) OVER ()) AS a, greatest(1e-6::DOUBLE, count(l.doc_id) / sum(count(l.doc_id)) OVER ()) AS e
 FROM scores s LEFT JOIN (SELECT DISTINCT doc_id FROM screening_labels WHERE split = 'train') l ON l.doc_id = s.doc_id GROUP BY floor(p_relevant * 10))"""
KIND = "CASE " + " ".join(f"WHEN regexp_matches(query, '{p}') THEN '{k}'" for p, k in op.JOB_KINDS) + " ELSE 'other' END"


def train_scores(d):
    train = d.screening_labels().filter("split = 'train'").select("doc_id").distinct().withColumn("t", F.lit(True))
    return d.scores().select("doc_id", "p_relevant").join(train, "doc_id", "left")


def psi(d):
    return op.psi(train_scores(d), F.col("t").isNotNull())


@query("override_rate", f"SELECT round(override_rate, 6) AS override_rate, n_decisions FROM ({OVERRIDE})")
def _(d):
    return op.override_rate(d.decisions(), d.scores()).withColumn("override_rate", F.round("override_rate", 6))


@query("score_histogram", "SELECT floor(p_relevant * 10)::BIGINT AS bucket, count(*) AS n FROM scores GROUP BY 1")
def _(d):
    return op.histogram(d.scores())


@query("score_psi", f"SELECT round(psi, 6) AS psi, psi > 0.2 AS drifted FROM ({PSI})")
def _(d):
    return psi(d).withColumn("psi", F.round("psi", 6))


@query("drift_alert", f"""SELECT round(override_rate, 6) AS override_rate, round(psi, 6) AS psi, CASE WHEN override_rate > 0.2 OR psi > 0.2 THEN 'label more' ELSE 'none' END AS action FROM ({OVERRIDE}), ({PSI})""")
def _(d):
    a = op.drift_alert(op.override_rate(d.decisions(), d.scores()), psi(d))
    return a.select(F.round("override_rate", 6).alias("override_rate"), F.round("psi", 6).alias("psi"), "action")


@query("cost_ledger", f"""SELECT creation_time::DATE AS day, {KIND} AS job_kind, count(*) AS n_jobs, round(sum(total_bytes_billed)::DOUBLE / 1073741824, 6) AS gb_billed, round(sum(total_slot_ms)::DOUBLE / 3600000, 6) AS slot_hours
FROM job_log WHERE creation_time >= (SELECT max(creation_time) FROM job_log) - INTERVAL 30 DAY AND regexp_matches(query, 'evidence') GROUP BY ALL""")
def _(d):
    c = op.cost_ledger(d.job_log(), "evidence")
    return c.select("day", "job_kind", "n_jobs", F.round("gb_billed", 6).alias("gb_billed"), F.round("slot_hours", 6).alias("slot_hours"))


@query("regex_classify", f"SELECT {KIND} AS job_kind, count(*) AS n_jobs FROM job_log GROUP BY 1")
def _(d):
    return d.job_log().groupBy(op.classify("query").alias("job_kind")).agg(F.count(F.lit(1)).alias("n_jobs"))


@query("run_cost_by_type", """SELECT learning_type, count(*) AS n_runs, round(sum(bytes_billed)::DOUBLE / 1073741824, 4) AS gb_billed, round(sum(slot_ms)::DOUBLE / 3600000, 6) AS slot_hours FROM runs GROUP BY 1""")
def _(d):
    return op.run_cost(d.runs()).select("learning_type", "n_runs", F.round("gb_billed", 4).alias("gb_billed"), F.round("slot_hours", 6).alias("slot_hours"))
