"""Text and JSON queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.catalog.screening import predictions
from siftmap.functions import jsontext, text
from siftmap.operators import generate as gen
from siftmap.operators import screening as scr
from siftmap.operators.evidence import centroids, top_titles
from siftmap.operators.learning import weak_labels
from siftmap.operators.vector import assign
from siftmap.session import new_path


def js(path: str) -> str:
    return f"json_extract_string(j, '$.{path}')"


@query("clean_json", "SELECT row_id, j IS NOT NULL AS parsed, length(trim(j::VARCHAR, chr(10)))::BIGINT AS chars FROM parsed")
def _(d):
    r = d.replies().select("row_id", jsontext.clean_json("raw").alias("j"))
    return r.select("row_id", F.col("j").isNotNull().alias("parsed"), F.length(F.btrim("j", F.lit("\n"))).cast("bigint").alias("chars"))


@query("json_extract_scalar", f"SELECT row_id, {js('label')} AS label, {js('confidence')} AS confidence, {js('reason')} AS reason, {js('extra.k')} AS k FROM parsed")
def _(d):
    r = d.replies().select("row_id", jsontext.clean_json("raw").alias("j"))
    return r.select("row_id", *[jsontext.scalar("j", f"$.{p}").alias(n) for p, n in [("label", "label"), ("confidence", "confidence"), ("reason", "reason"), ("extra.k", "k")]])


@query("json_array_explode", """SELECT row_id, json_extract_string(r, '$.action') AS action, TRY_CAST(json_extract_string(r, '$.effect_size') AS DOUBLE) AS effect_size
FROM (SELECT row_id, unnest(json_extract(j, '$.records[*]')) AS r FROM parsed WHERE j IS NOT NULL)""")
def _(d):
    return jsontext.outcome_records(d.replies().select("row_id", "raw"), "$.records").select("row_id", "action", "effect_size")


@query("join_lateral_unnest", """SELECT event_type, count(*) AS n_records, count(DISTINCT row_id) AS n_replies, round(sum(TRY_CAST(json_extract_string(r, '$.effect_size') AS DOUBLE)), 4) AS total_effect
FROM (SELECT row_id, event_type, unnest(json_extract(j, '$.records[*]')) AS r FROM parsed WHERE j IS NOT NULL) GROUP BY event_type""")
def _(d):
    r = jsontext.outcome_records(d.replies().select("row_id", "event_type", "raw"), "$.records")
    per = r.groupBy("event_type", "row_id").agg(F.count(F.lit(1)).alias("n"), F.sum("effect_size").alias("e"))
    return per.groupBy("event_type").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_replies"), F.round(F.sum("e"), 4).alias("total_effect"))


@query("safe_cast", """SELECT event_id, TRY_CAST(substr(props, 7, 2) AS INTEGER) AS as_int, TRY_CAST(event_type AS DOUBLE) AS as_double, TRY_CAST(props AS BOOLEAN) AS as_bool FROM events""")
def _(d):
    return d.raw("events").select(
        "event_id", F.substring("props", 7, 2).try_cast("int").alias("as_int"),
        F.col("event_type").try_cast("double").alias("as_double"), F.col("props").try_cast("boolean").alias("as_bool"),
    )


@query("cluster_label_parse", f"SELECT doc_id AS cluster_id, {js('label')} AS label, {js('criterion')} AS sector, {js('decision')} AS evidence_focus, {js('extra.none')} AS coherence_guess FROM parsed")
def _(d):
    # the supplied replies use other keys, so they are renamed in the text before parsing
    raw = F.replace(F.replace(F.col("raw"), F.lit('"criterion"'), F.lit('"sector"')), F.lit('"decision"'), F.lit('"evidence_focus"'))
    r = d.replies().select(F.col("doc_id").alias("cluster_id"), F.lit(1).alias("n_docs"), raw.alias("model_raw"))
    return jsontext.cluster_labels(r).drop("n_docs", "model_raw")


@query("metadata_extract_parse", f"""SELECT row_id AS doc_id, {js('label')} AS region, NULL::VARCHAR AS country, NULL::VARCHAR AS sector, NULL::VARCHAR AS hazard, {js('decision')} AS evidence_type, NULL::VARCHAR AS adaptation_type,
 CAST({js('agrees_with_model')} AS BOOLEAN) AS outcome_reported, {js('confidence')} AS confidence_language, {js('reason')} AS rationale FROM parsed WHERE j IS NOT NULL""")
def _(d):
    names = {"label": "region", "decision": "evidence_type", "agrees_with_model": "outcome_reported", "confidence": "confidence_language", "reason": "rationale"}
    raw = F.col("raw")
    for a, b in names.items():
        raw = F.replace(raw, F.lit(f'"{a}":'), F.lit(f'"{b}":'))
    return jsontext.metadata(d.replies().select(F.col("row_id").alias("doc_id"), raw.alias("raw")))


@query("second_opinion_parse", f"""SELECT row_id, doc_id, j IS NOT NULL AS parsed, {js('decision')} AS llm_decision, {js('criterion')} AS criterion, CAST({js('agrees_with_model')} AS BOOLEAN) AS agrees_with_model, {js('reason')} AS reason FROM parsed""")
def _(d):
    return jsontext.second_opinion(d.replies().drop("event_type"))


@query("prelabel_parse", f"""SELECT sha256(concat_ws('|', t.task_id, p.row_id)) AS label_id, t.task_id, p.row_id, {js('label')} AS label, 'llm' AS source, TRY_CAST({js('confidence')} AS DOUBLE) AS confidence, NULL::VARCHAR AS rationale
FROM parsed p JOIN label_tasks t ON t.task_id = 'task_' || p.doc_id WHERE list_contains(t.label_space, {js('label')})""")
def _(d):
    r = d.replies().select("row_id", "raw", F.concat(F.lit("task_"), "doc_id").alias("task_id"))
    return jsontext.prelabels(r.join(d.label_tasks().select("task_id", "label_space"), "task_id"))


@query("prompt_build", f"""SELECT doc_id, md5('{text.SECOND_OPINION}' || chr(10) || chr(10) || 'Model P(relevant): ' || coalesce(round(p_relevant, 2)::VARCHAR, '') || chr(10) || 'Title: ' || title || chr(10) || 'Region: ' || coalesce(region, 'unknown')) AS prompt_md5 FROM predictions""".replace("coalesce(round(p_relevant, 2)::VARCHAR, '')", "printf('%.2f', p_relevant)"))
def _(d):
    p = text.prompt(text.SECOND_OPINION, {"Model P(relevant)": F.format_string("%.2f", "p_relevant"), "Title": "title", "Region": "region"}, missing="unknown")
    return predictions(d).select("doc_id", F.md5(p).alias("prompt_md5"))


@query("generate_text_batch")
def _(d):
    """Second opinions on the uncertain band by the built-in rules."""
    band = scr.uncertain_band(predictions(d)).select("doc_id", "title", "p_relevant").join(d.corpus().select("doc_id", "abstract"), "doc_id")
    return gen.second_opinions(band)


@query("passages_format", """SELECT cluster_id, string_agg('[' || doc_id || ' p.' || page || '] ' || title, chr(10) ORDER BY d, doc_id) AS passages, count(*) AS n_passages FROM (
 SELECT k.cluster_id, c.doc_id, c.title, c.n_pages AS page, round(k.dist_to_centroid, 9) AS d FROM doc_clusters k JOIN corpus c ON k.doc_id = c.doc_id
 QUALIFY row_number() OVER (PARTITION BY k.cluster_id ORDER BY round(k.dist_to_centroid, 9), k.doc_id) <= 8) GROUP BY cluster_id""")
def _(d):
    w = Window.partitionBy("cluster_id").orderBy("distance", "doc_id")
    near = assign(d.clustered(), centroids(d.clustered())).join(d.corpus().select("doc_id"), "doc_id", "left_semi")
    near = near.withColumnRenamed("dist_to_centroid", "distance").withColumn("rn", F.row_number().over(w)).filter("rn <= 8")
    hits = near.join(d.corpus().select("doc_id", F.col("n_pages").alias("page"), F.col("title").alias("content")), "doc_id")
    return text.format_passages(hits, "cluster_id")


@query("citation_extract", "SELECT c.text_id, c.cited_id, c.page, k.doc_id IS NOT NULL AS known FROM citations c LEFT JOIN corpus k ON k.doc_id = c.cited_id")
def _(d):
    c = text.resolve(text.citations(d.cited_texts(), "text_id", "body"), d.corpus())
    return c.select("text_id", "cited_id", "page", "known")


@query("citation_precision", """SELECT count(*) AS n_cited, round(count_if(k.doc_id IS NOT NULL) / count(*), 6) AS known_share,
 round(count_if(k.doc_id IS NOT NULL AND o.doc_id IS NOT NULL) / count(*), 6) AS verified_share
FROM citations c LEFT JOIN corpus k ON k.doc_id = c.cited_id LEFT JOIN (SELECT DISTINCT doc_id FROM decisions WHERE decision_type = 'citation_ok') o ON o.doc_id = c.cited_id""")
def _(d):
    p = text.citation_precision(text.citations(d.cited_texts(), "text_id", "body"), d.corpus(), d.decisions())
    return p.select("n_cited", F.round("known_share", 6).alias("known_share"), F.round("verified_share", 6).alias("verified_share"))


@query("filter_in_list", """SELECT doc_id, title, year, region, source_type FROM corpus WHERE doc_id IN (SELECT cited_id FROM citations)""")
def _(d):
    cited = text.citations(d.cited_texts(), "text_id", "body").select(F.col("cited_id").alias("doc_id"))
    return d.corpus().select("doc_id", "title", "year", "region", "source_type").join(cited, "doc_id", "left_semi")


@query("chunk_documents", """SELECT doc_id || '-c' || i AS chunk_id, doc_id, (1 + i // 3)::INTEGER AS page, i::INTEGER AS chunk_index, rtrim(trim(p, s), '.') || '.' AS text, st::INTEGER AS char_start, (st + length(p))::INTEGER AS char_end
FROM (SELECT doc_id, p, i, s, coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (
 SELECT doc_id, unnest(string_split(abstract, '. ')) AS p, unnest(range(0, len(string_split(abstract, '. ')))) AS i, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS s FROM corpus))
WHERE trim(p, s) <> ''""")
def _(d):
    return text.chunks(d.corpus())


@query("context_key", """SELECT coalesce(region, '?') || '|' || coalesce(sector, '?') || '|' || coalesce(hazard, '?') AS context_similarity_key, count(*) AS n_docs FROM corpus GROUP BY 1""")
def _(d):
    return d.corpus().groupBy(text.context_key("region", "sector", "hazard").alias("context_similarity_key")).agg(F.count(F.lit(1)).alias("n_docs"))


# fixed values: words the supplied prose holds, standing in for the domain keywords, with explicit
# word boundaries as engines disagree about \\b next to accented letters
KEYWORDS = r"(^|[^a-z0-9_])(there|which|dans|avec|nicht|para|the[a-z0-9_]*ble)([^a-z0-9_]|$)"


@query("weak_label_keywords", f"""SELECT doc_id, CASE WHEN ('0x'||substr(md5(doc_id),1,8))::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split,
 regexp_matches(lower(title || ' ' || abstract), '{KEYWORDS}')::INTEGER AS label, 'keywords' AS label_origin FROM corpus""")
def _(d):
    return weak_labels(d.corpus(), KEYWORDS)


def in_two_runs(d, name, step, rows):
    """A batch step which stops half way and goes on from what it has appended; its table."""
    path = new_path(d.spark, name)
    half = step(rows.filter("abs(xxhash64(doc_id)) % 2 = 0"))
    half.write.mode("append").parquet(path)
    done = d.spark.read.schema(half.schema).parquet(path)
    step(gen.todo(rows, done)).write.mode("append").parquet(path)
    return d.spark.read.schema(half.schema).parquet(path)


@query("metadata_run", "SELECT doc_id, count(*) AS replies FROM corpus GROUP BY 1")
def _(d):
    out = in_two_runs(d, "metadata", gen.extract_metadata, d.corpus().select("doc_id", "title", "abstract"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("replies"))


@query("outcome_run")
def _(d):
    return in_two_runs(d, "outcomes", gen.extract_outcomes, d.corpus().select("doc_id", "title", "abstract", "region", "sector", "hazard"))


@query("cluster_naming_run", "SELECT cluster_id, count(*)::BIGINT AS n_docs FROM doc_clusters k JOIN corpus c ON c.doc_id = k.doc_id GROUP BY 1")
def _(d):
    near = assign(d.clustered(), centroids(d.clustered()))
    return gen.label_clusters(top_titles(near, d.corpus())).filter("label IS NOT NULL").select("cluster_id", "n_docs")


@query("prelabel_run", """SELECT t.task_id, count(*) AS n_rows FROM label_tasks t, corpus c WHERE t.task_id IN ('task_1', 'task_2') AND NOT EXISTS (
  SELECT 1 FROM annotations a WHERE a.source = 'llm' AND a.task_id = t.task_id AND a.row_id = c.doc_id) GROUP BY 1""")
def _(d):
    tasks = d.label_tasks().filter("task_id IN ('task_1', 'task_2')")
    rows = d.corpus().select(F.col("doc_id").alias("row_id"), "title", "abstract").withColumn("task_id", F.explode(F.array(F.lit("task_1"), F.lit("task_2"))))
    out = gen.prelabel(rows, tasks, d.annotations(), {"Title": "title", "Abstract": "abstract"})
    return out.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_rows"))
