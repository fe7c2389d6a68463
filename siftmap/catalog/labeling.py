"""Labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.catalog.gaps import expected
from siftmap.catalog.screening import OPINIONS_SQL, opinions, predictions
from siftmap.operators import labeling as op
from siftmap.operators.gaps import by_region_plain, under_covered

NEWEST = """SELECT * FROM annotations WHERE source = 'llm' QUALIFY row_number() OVER (PARTITION BY task_id, row_id ORDER BY labeled_at DESC, label_id DESC) = 1"""
MAJORITY = """SELECT task_id, row_id, label FROM (SELECT task_id, row_id, label, count(*) AS n FROM annotations WHERE source = 'human' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id, row_id ORDER BY n DESC, label) = 1"""


def rows(d):
    """The dataset behind the labelling task."""
    return d.corpus().select(F.col("doc_id").alias("row_id"), "title")


@query("label_gold", "SELECT task_id, row_id, label, gold_source FROM gold")
def _(d):
    return op.gold(d.annotations())


@query("top1_per_group", MAJORITY)
def _(d):
    return op.human_majority(d.annotations())


@query("llm_label_one_per_row", f"SELECT task_id, row_id, label AS llm_label, confidence AS llm_conf, rationale AS llm_rationale FROM ({NEWEST})")
def _(d):
    return op.model_labels(d.annotations())


@query("label_queue", f"""SELECT c.doc_id AS row_id, c.title, l.label AS llm_label, l.confidence AS llm_conf, l.rationale AS llm_rationale, coalesce(h.n, 0) AS n_human_labels
FROM corpus c LEFT JOIN ({NEWEST}) l ON l.row_id = c.doc_id AND l.task_id = 'task_1' LEFT JOIN (SELECT row_id, count(*) AS n FROM annotations WHERE source = 'human' AND task_id = 'task_1' GROUP BY 1) h ON h.row_id = c.doc_id
WHERE NOT EXISTS (SELECT 1 FROM annotations m WHERE m.row_id = c.doc_id AND m.task_id = 'task_1' AND m.source = 'human' AND m.annotator = 'A2')
ORDER BY coalesce(h.n, 0), abs(coalesce(l.confidence, 0.5::DOUBLE) - 0.5), md5(c.doc_id), c.doc_id LIMIT 25""")
def _(d):
    return op.queue(rows(d), d.annotations(), "task_1", "A2")


@query("label_progress", """SELECT task_id, (SELECT count(*) FROM corpus) AS n_rows, count(DISTINCT CASE WHEN source = 'human' THEN row_id END) AS n_human_rows,
 count(DISTINCT CASE WHEN source = 'llm' THEN row_id END) AS n_llm_rows, count(DISTINCT CASE WHEN source = 'human' THEN annotator END) AS n_annotators FROM annotations GROUP BY task_id""")
def _(d):
    return op.progress(rows(d), d.annotations())


@query("label_distribution", "SELECT task_id, label, source, count(*) AS n FROM annotations GROUP BY ALL")
def _(d):
    return op.distribution(d.annotations())


@query("label_agreement", f"""SELECT t.task_id, round(p.agree, 6) AS human_human_agreement, coalesce(p.n, 0) AS n_double_labelled, round(m.agree, 6) AS human_llm_agreement
FROM (SELECT DISTINCT task_id FROM annotations) t
LEFT JOIN (SELECT a.task_id, avg((a.label = b.label)::INTEGER::DOUBLE) AS agree, count(*) AS n FROM annotations a JOIN annotations b
  ON a.task_id = b.task_id AND a.row_id = b.row_id AND a.annotator < b.annotator WHERE a.source = 'human' AND b.source = 'human' GROUP BY 1) p ON p.task_id = t.task_id
LEFT JOIN (SELECT g.task_id, avg((g.label = l.label)::INTEGER::DOUBLE) AS agree FROM ({MAJORITY}) g JOIN ({NEWEST}) l ON g.task_id = l.task_id AND g.row_id = l.row_id GROUP BY 1) m ON m.task_id = t.task_id""")
def _(d):
    a = op.agreement(d.annotations())
    return a.select("task_id", F.round("human_human_agreement", 6).alias("human_human_agreement"), "n_double_labelled", F.round("human_llm_agreement", 6).alias("human_llm_agreement"))


@query("join_self_nonequi", """SELECT a.task_id, a.row_id, count(*) AS n_pairs, count_if(a.label = b.label)::BIGINT AS n_agree
FROM annotations a JOIN annotations b ON a.task_id = b.task_id AND a.row_id = b.row_id AND a.annotator < b.annotator WHERE a.source = 'human' AND b.source = 'human' GROUP BY ALL""")
def _(d):
    return op.pair_counts(d.annotations(), ["task_id", "row_id"]).filter("n_pairs > 0")


@query("label_validate", """SELECT a.label_id, coalesce(list_contains(t.label_space, a.label), false) AS accepted FROM annotations a LEFT JOIN label_tasks t ON t.task_id = a.task_id""")
def _(d):
    return op.validate(d.annotations(), d.label_tasks()).select("label_id", "accepted")


ACTIVE = f"""WITH cand AS (SELECT p.doc_id AS row_id, p.p_relevant, p.language, p.source_type, p.title, p.region, l.confidence AS llm_conf, o.llm_decision = 'include' AS inc
  FROM predictions p LEFT JOIN ({NEWEST}) l ON l.row_id = p.doc_id AND l.task_id = 'task_1' LEFT JOIN ({OPINIONS_SQL}) o ON o.doc_id = p.doc_id),
 thin AS (SELECT e.region FROM expected e LEFT JOIN (SELECT region, count(*) AS n FROM predictions GROUP BY region) c ON c.region = e.region
   WHERE coalesce(n, 0) / (SELECT count(*) FROM predictions) / e.expected_share < 0.6),
 f AS (SELECT row_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t,
  (abs(p_relevant - 0.5) <= 0.2 OR coalesce(llm_conf, 1) <= 0.6) AS uncertain,
  ((region IS NOT NULL AND region IN (SELECT region FROM thin))::INTEGER + (language <> 'en')::INTEGER + (source_type <> 'peer_reviewed')::INTEGER) AS coverage_points,
  coalesce((p_relevant >= 0.5) <> inc, false) AS disagreement, round(abs(p_relevant - 0.5), 9) AS margin FROM cand),
 best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY t ORDER BY NOT uncertain, -coverage_points, NOT disagreement, margin, row_id) = 1)
SELECT row_id, uncertain, coverage_points, disagreement FROM best ORDER BY NOT uncertain, -coverage_points, NOT disagreement, margin, row_id LIMIT 40"""


@query("active_learning_select", ACTIVE)
def _(d):
    p = predictions(d)
    thin = under_covered(by_region_plain(p, expected(d), threshold=0.0)).select("region", F.lit(True).alias("rare"))
    cand = (
        p.join(op.model_labels(d.annotations().filter("task_id = 'task_1'")).select(F.col("row_id").alias("doc_id"), "llm_conf"), "doc_id", "left")
        .join(opinions(d).select("doc_id", (F.col("llm_decision") == "include").alias("llm_include")), "doc_id", "left")
        .join(thin, "region", "left").withColumnRenamed("doc_id", "row_id")
    )
    return op.select_batch(cand, 40, F.coalesce("rare", F.lit(False)))
