"""Plain relational steps, written directly with Spark's own operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.catalog.screening import LATEST_SQL, predictions
from siftmap.operators.screening import flag_labelled, latest_decision


@query("scan_table", "SELECT doc_id, lang FROM documents")
def _(d):
    return d.raw("documents").select("doc_id", "lang")


@query("corpus_union", """SELECT doc_id, title, abstract, year, source_type, language, region, credibility_score IS NULL AS unscored, outcome_reported, n_pages, 'synthetic' AS provenance FROM corpus
UNION ALL SELECT 'p' || page_id, url, coalesce(html, ''), TRY_CAST(regexp_extract(url, '/([0-9]+)\\?', 1) AS INTEGER), 'peer_reviewed', 'en', NULL, true, NULL, NULL, 'ingested' FROM pages""")
def _(d):
    pages = d.raw("pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.col("url").alias("title"), F.coalesce("html", F.lit("")).alias("abstract"),
        F.regexp_extract("url", r"/([0-9]+)\?", 1).try_cast("int").alias("year"), F.lit("peer_reviewed").alias("source_type"), F.lit("en").alias("language"),
        F.lit("ingested").alias("provenance"),
    )
    both = d.corpus().withColumn("provenance", F.lit("synthetic")).unionByName(pages, allowMissingColumns=True)
    return both.select(
        "doc_id", "title", "abstract", "year", "source_type", "language", "region", F.col("credibility_score").isNull().alias("unscored"),
        "outcome_reported", "n_pages", "provenance",
    )


@query("corpus_embeddings_union", """SELECT doc_id, len(embedding)::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS vec_sum FROM (
 SELECT doc_id, embedding FROM corpus_embeddings UNION ALL SELECT 'c' || label, list_reverse(embedding) FROM embeddings)""")
def _(d):
    other = d.raw("embeddings").select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("doc_id"), F.reverse("embedding").alias("embedding"))
    both = d.embeddings().unionByName(other)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return both.select("doc_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("vec_sum"))


@query("union_all", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT lang, count(*) FROM documents GROUP BY 1")
def _(d):
    a = d.raw("events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(d.raw("documents").groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("filter_dynamic", "SELECT doc_id, region FROM predictions WHERE NOT already_labelled AND region = 'Asia'")
def _(d):
    asked = {"only_unlabelled": True, "region": "Asia"}
    preds = [F.lit(True)]
    if asked.get("only_unlabelled"):
        preds.append(~F.col("already_labelled"))
    if asked.get("region"):
        preds.append(F.col("region") == asked["region"])
    return predictions(d).filter(reduce(and_, preds)).select("doc_id", "region")


@query("filter_like_prefix", "SELECT decision_id, doc_id FROM decisions WHERE decision_type LIKE 'screen_%'")
def _(d):
    return d.decisions().filter(F.col("decision_type").like("screen_%")).select("decision_id", "doc_id")


@query("project_round", "SELECT doc_id, round(p_relevant, 3) AS p3, round(p_relevant, 1) AS p1 FROM scores")
def _(d):
    return d.scores().select("doc_id", F.round("p_relevant", 3).alias("p3"), F.round("p_relevant", 1).alias("p1"))


@query("project_except", "SELECT * EXCLUDE (created_by, started_at) FROM runs")
def _(d):
    return d.runs().drop("created_by", "started_at", "sql_text")


@query("join_inner_equi", "SELECT s.doc_id, c.title, c.year, s.cluster_id FROM scores s JOIN corpus c ON s.doc_id = c.doc_id")
def _(d):
    return d.scores().select("doc_id", "cluster_id").join(d.corpus().select("doc_id", "title", "year"), "doc_id")


@query("join_left_outer", "SELECT c.doc_id, c.region, m.region AS region_found FROM corpus c LEFT JOIN metadata m ON m.doc_id = c.doc_id")
def _(d):
    return d.corpus().select("doc_id", "region").join(d.metadata().select("doc_id", F.col("region").alias("region_found")), "doc_id", "left")


@query("join_left_flag", "SELECT s.doc_id, l.doc_id IS NOT NULL AS already_labelled FROM scores s LEFT JOIN (SELECT DISTINCT doc_id FROM screening_labels) l ON l.doc_id = s.doc_id")
def _(d):
    return flag_labelled(d.scores().select("doc_id"), d.screening_labels())


@query("join_anti_isnull", "SELECT c.doc_id FROM corpus c LEFT JOIN metadata m ON m.doc_id = c.doc_id WHERE m.doc_id IS NULL")
def _(d):
    return d.corpus().select("doc_id").join(d.metadata().select("doc_id"), "doc_id", "left_anti")


@query("join_anti_not_in", "SELECT DISTINCT row_id FROM annotations WHERE source = 'llm' AND row_id NOT IN (SELECT doc_id FROM screening_labels)")
def _(d):
    # the key is never NULL, so NOT IN is a plain anti join instead of a null-aware one
    llm = d.annotations().filter("source = 'llm'").select("row_id").distinct()
    return llm.join(d.screening_labels().select(F.col("doc_id").alias("row_id")), "row_id", "left_anti")


@query("join_cross_scalar", "SELECT doc_id, round(p_relevant / t.total, 9) AS share FROM scores, (SELECT sum(p_relevant) AS total FROM scores) t")
def _(d):
    # a one-row side is a scalar subquery, so no cross join is planned
    total = d.scores().agg(F.sum("p_relevant")).scalar()
    return d.scores().select("doc_id", F.round(F.col("p_relevant") / total, 9).alias("share"))


@query("subquery_scalar", """SELECT region, count(*) AS n, round(count(*) / (SELECT count(*) FROM corpus), 6) AS share, (SELECT max(year) FROM corpus) AS newest FROM corpus GROUP BY region""")
def _(d):
    n, newest = d.corpus().agg(F.count(F.lit(1))).scalar(), d.corpus().agg(F.max("year")).scalar()
    return d.corpus().groupBy("region").agg(F.count(F.lit(1)).alias("n")).select("region", "n", F.round(F.col("n") / n, 6).alias("share"), newest.alias("newest"))


@query("join_latest_per_key", f"SELECT s.doc_id, round(s.p_relevant, 6) AS p_relevant, h.human_decision FROM scores s LEFT JOIN ({LATEST_SQL}) h ON h.doc_id = s.doc_id")
def _(d):
    return d.scores().select("doc_id", F.round("p_relevant", 6).alias("p_relevant")).join(latest_decision(d.decisions()), "doc_id", "left")


@query("latest_row", "SELECT eval_id, metrics_json FROM evaluations ORDER BY evaluated_at DESC, eval_id DESC LIMIT 1")
def _(d):
    return d.evaluations().orderBy(F.desc("evaluated_at"), F.desc("eval_id")).limit(1).select("eval_id", "metrics_json")
