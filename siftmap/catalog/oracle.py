"""The same domain tables as `siftmap.sources.domain`, in DuckDB SQL, for checking only.

`sql(body)` prefixes a query with the CTEs it mentions.
"""

from __future__ import annotations

import re

_P = "1/(1+exp(-(8*embedding[1]::DOUBLE + 8*embedding[2]::DOUBLE + 8*embedding[3]::DOUBLE)))"
_B = "('0x'||substr(md5({k}),1,8))::BIGINT"


def bucket(key: str) -> str:
    return _B.format(k=key)


CTES: dict[str, str] = {
    "corpus": """
SELECT doc_id::VARCHAR AS doc_id, split_part(split_part(text, chr(10), 1), '. ', 1) AS title, text AS abstract,
 (2005 + (n_chars*7 + doc_id) % 22)::INTEGER AS year,
 CASE WHEN i < 14 THEN 'peer_reviewed' WHEN i < 16 THEN 'preprint' WHEN i < 18 THEN 'policy_report'
      WHEN i = 18 THEN 'ngo_report' ELSE 'news' END AS source_type,
 lang AS language,
 CASE WHEN b <= 1 THEN 'Africa' WHEN b <= 4 THEN 'Asia' WHEN b = 5 THEN 'Australasia'
      WHEN b = 6 THEN 'Central and South America' WHEN b <= 11 THEN 'Europe' WHEN b <= 16 THEN 'North America'
      WHEN b = 17 THEN 'Small Islands' WHEN b = 18 THEN 'Polar Regions' END AS region,
 'country_' || (n_chars % 40) AS country, 'sector_' || (doc_id % 7) AS sector, 'hazard_' || (n_chars % 13) AS hazard,
 CASE WHEN m <= 2 THEN 'adaptation' WHEN m = 3 THEN 'maladaptation' WHEN m <= 5 THEN 'vulnerability'
      WHEN m <= 8 THEN 'impact' ELSE 'off_topic' END AS evidence_type,
 CASE WHEN m <= 3 THEN ['technological','institutional','behavioural','nature-based'][doc_id % 4 + 1] END AS adaptation_type,
 (m < 4 AND doc_id % 3 = 0) AS outcome_reported,
 ['very high','high','medium','low'][n_chars % 4 + 1] AS confidence_language,
 ['high','medium','low'][doc_id % 3 + 1] AS evidence_agreement,
 0.3::DOUBLE + (n_chars % 70)::DOUBLE / 100.0::DOUBLE AS credibility_score,
 CASE WHEN i < 14 THEN '10.5555/' || doc_id END AS doi,
 floor(1 + n_chars / 1800.0)::INTEGER AS n_pages,
 CASE WHEN i < 10 THEN 'synthetic' ELSE 'ingested' END AS provenance
FROM (SELECT *, substr(source,4)::INTEGER AS i, n_chars % 20 AS b, (doc_id*7 + n_chars) % 10 AS m FROM documents)""",
    "corpus_embeddings": "SELECT vec_id::VARCHAR AS doc_id, embedding FROM embeddings",
    "scores": f"SELECT vec_id::VARCHAR AS doc_id, {_P} AS p_relevant, label::BIGINT AS cluster_id FROM embeddings",
    "relevant_vectors": f"SELECT vec_id::VARCHAR AS doc_id, label::BIGINT AS cluster_id, embedding FROM embeddings WHERE {_P} >= 0.5",
    "clusters": "SELECT doc_id, cluster_id FROM scores WHERE p_relevant >= 0.5",
    "cluster_labels": """
SELECT cluster_id, count(*)::BIGINT AS n_docs, 'Topic cluster ' || cluster_id AS label, 'sector_' || (cluster_id % 7) AS sector,
 ['impact','adaptation','mixed'][cluster_id % 3 + 1] AS evidence_focus, ['high','medium','low'][cluster_id % 3 + 1] AS coherence_guess
FROM clusters GROUP BY cluster_id""",
    "screening_labels": f"""
SELECT doc_id::VARCHAR AS doc_id, annotator, label,
 CASE WHEN bk < 70 THEN 'train' WHEN bk < 85 THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, 'A1' AS annotator, quality AS label, {_B.format(k='doc_id::VARCHAR')} % 100 AS bk FROM labels
      UNION ALL SELECT doc_id, 'A2', 1 - toxic, {_B.format(k='doc_id::VARCHAR')} % 100 FROM labels)""",
    "predictions": """
SELECT s.doc_id, c.title, c.year, c.region, c.source_type, c.language, c.provenance, s.p_relevant, s.cluster_id,
 l.doc_id IS NOT NULL AS already_labelled
FROM scores s JOIN corpus c ON s.doc_id = c.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM screening_labels) l ON s.doc_id = l.doc_id""",
    "ranked": """
SELECT *, rank() OVER (ORDER BY p_relevant DESC) AS priority_rank,
 sum(p_relevant) OVER (ORDER BY p_relevant DESC, md5(doc_id), doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - p_relevant AS expected_relevant_remaining
FROM predictions""",
    "centroids": """
SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (
 SELECT cluster_id, i, avg(embedding[i]::DOUBLE) AS m FROM relevant_vectors, range(1, 65) t(i) GROUP BY cluster_id, i) GROUP BY cluster_id""",
    "doc_clusters": """
SELECT doc_id, cluster_id, dist AS dist_to_centroid FROM (
 SELECT v.doc_id, c.cluster_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.centroid), 9) AS dist,
  row_number() OVER (PARTITION BY v.doc_id ORDER BY round(1 - list_cosine_similarity(v.embedding::DOUBLE[], c.centroid), 9), c.cluster_id) AS rn
 FROM relevant_vectors v, centroids c) WHERE rn = 1""",
    "metadata": """
SELECT (page_id * 2)::VARCHAR AS doc_id,
 ['Africa','Asia','Australasia','Central and South America','Europe','North America','Small Islands','Polar Regions'][page_id % 8 + 1] AS region,
 'sector_' || (page_id % 5) AS sector, CASE WHEN length(url) % 2 = 0 THEN 'adaptation' ELSE 'impact' END AS evidence_type,
 length(url) % 3 = 0 AS outcome_reported FROM pages""",
    "expected": """
SELECT * FROM (VALUES ('Africa', 0.18::DOUBLE), ('Asia', 0.40::DOUBLE), ('Australasia', 0.01::DOUBLE), ('Central and South America', 0.09::DOUBLE),
 ('Europe', 0.09::DOUBLE), ('North America', 0.07::DOUBLE), ('Small Islands', 0.01::DOUBLE), ('Polar Regions', 0.01::DOUBLE)) t(region, expected_share)""",
    "decisions": """
SELECT event_id::VARCHAR AS decision_id, user_id::VARCHAR AS doc_id,
 CASE WHEN event_type IN ('view','signup') THEN user_id % 10 END AS cluster_id,
 CASE event_type WHEN 'click' THEN 'screen_include' WHEN 'error' THEN 'screen_exclude' WHEN 'view' THEN 'cluster_coherent'
  WHEN 'signup' THEN 'cluster_incoherent' WHEN 'purchase' THEN 'citation_ok' END AS decision_type,
 'rev' || (user_id % 7) AS reviewer, props AS note, ts AS decided_at FROM events""",
    "submitted": """
SELECT event_id::VARCHAR AS decision_id, CASE WHEN value >= 2 THEN user_id::VARCHAR END AS doc_id,
 CASE WHEN event_type IN ('view','signup') THEN user_id % 10 END AS cluster_id,
 CASE WHEN value > 200 THEN 'shrug' WHEN event_type = 'click' THEN 'screen_include' WHEN event_type = 'error' THEN 'screen_exclude'
  WHEN event_type = 'view' THEN 'cluster_coherent' WHEN event_type = 'signup' THEN 'cluster_incoherent' ELSE 'citation_ok' END AS decision_type,
 CASE WHEN value BETWEEN 10 AND 12 THEN '' ELSE 'rev' || (user_id % 7) END AS reviewer,
 CASE WHEN value BETWEEN 150 AND 200 THEN repeat(props, 200) ELSE props END AS note, ts AS decided_at FROM events""",
    "annotations": """
SELECT event_id::VARCHAR AS label_id, 'task_' || (event_id // 3 % 4) AS task_id, user_id::VARCHAR AS row_id, event_type AS label,
 CASE WHEN event_id % 3 = 0 THEN 'llm' ELSE 'human' END AS source,
 CASE WHEN event_id % 3 = 0 THEN 'model' ELSE 'A' || (event_id % 5) END AS annotator,
 CASE WHEN event_id % 3 = 0 THEN round(least(1.0::DOUBLE, value / 50), 4) ELSE 1.0::DOUBLE END AS confidence,
 props AS rationale, ts AS labeled_at FROM events""",
    "outcomes": """
SELECT r_name || '|' || c_mktsegment AS context_similarity_key, p_type AS adaptation_type,
 CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'mixed' END AS outcome_direction, l_discount - l_tax AS effect_size
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    "runs": """
SELECT o_orderkey::VARCHAR AS run_id, 'ds_' || (o_custkey % 50) AS dataset_id, o_orderpriority AS learning_type,
 CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 trunc(o_totalprice * 1000000)::BIGINT AS bytes_billed, o_custkey * 1000 AS slot_ms, o_orderdate AS started_at, 'user_' || o_custkey AS created_by FROM orders""",
    "models": """
SELECT 'm' || o_orderkey AS model_id, o_orderkey::VARCHAR AS run_id, 'task_' || (o_custkey % 20) AS task, o_orderpriority AS learning_type,
 'models/' || o_orderkey AS artifact, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'""",
    "evaluations": """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS eval_id, 'm' || l_orderkey AS model_id,
 (l_quantity::INTEGER + 49) AS rec, CASE WHEN l_returnflag <> 'N' THEN trunc(99 - l_quantity / 2)::INTEGER END AS auc,
 CASE WHEN l_returnflag = 'N' THEN printf('{"recall": 0.%02d}', l_quantity::INTEGER + 49)
  ELSE printf('{"recall": 0.%02d, "roc_auc": 0.%02d}', l_quantity::INTEGER + 49, trunc(99 - l_quantity / 2)::INTEGER) END AS metrics_json,
 l_shipdate AS evaluated_at FROM lineitem""",
    "promotion_requests": """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS promotion_id, 'm' || l_orderkey AS model_id,
 ['archived','candidate','staging','production','retired'][l_linenumber % 5 + 1] AS to_stage,
 CASE WHEN l_tax < 0.005 THEN '  ' ELSE 'flag ' || l_returnflag END AS reason, 'actor_' || l_suppkey AS actor, l_shipdate AS promoted_at FROM lineitem""",
    "promotions": """
SELECT q.*, m.task, m.artifact, m.learning_type FROM promotion_requests q JOIN models m ON q.model_id = m.model_id
 LEFT JOIN (SELECT model_id, min(evaluated_at) AS first_eval FROM evaluations GROUP BY model_id) e ON q.model_id = e.model_id
WHERE to_stage IN ('candidate','staging','production','retired') AND trim(reason) <> ''
 AND (to_stage IN ('candidate','retired') OR first_eval <= promoted_at)""",
    "stages": """
SELECT m.model_id, m.task, m.artifact, m.learning_type,
 CASE WHEN l.to_stage IS NULL THEN 'candidate'
      WHEN l.to_stage = 'production' AND p.model_id <> m.model_id THEN 'staging' ELSE l.to_stage END AS stage
FROM models m
LEFT JOIN (SELECT * FROM promotions QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY promoted_at DESC, promotion_id DESC) = 1) l ON l.model_id = m.model_id
LEFT JOIN (SELECT * FROM promotions WHERE to_stage = 'production' QUALIFY row_number() OVER (PARTITION BY task ORDER BY promoted_at DESC, promotion_id DESC) = 1) p ON p.task = m.task""",
    "datasets": """
SELECT 'ds_' || p_partkey AS dataset_id, p_brand AS name, p_size::BIGINT AS version, p_name AS notes, p_partkey * 10 AS n_rows, p_partkey AS created_seq FROM part""",
    "label_tasks": """
SELECT 'task_' || s_suppkey AS task_id, 'ds_' || (s_suppkey * 3 % 40) AS dataset_id, CASE WHEN s_acctbal < 0 THEN 'closed' ELSE 'open' END AS status,
 CASE WHEN s_suppkey % 2 = 0 THEN ['click','view','error'] ELSE ['signup','purchase'] END AS label_space, s_suppkey AS created_seq FROM supplier""",
    "job_log": """
SELECT l_shipdate AS creation_time,
 ['SELECT * FROM ML.GENERATE_TEXT(MODEL evidence.m, TABLE', 'SELECT * FROM ML.GENERATE_EMBEDDING(MODEL evidence.m, TABLE',
  'CREATE OR REPLACE MODEL evidence.m AS SELECT', 'CREATE MODEL evidence.m AS SELECT', 'SELECT * FROM ML.FORECAST(MODEL evidence.m, TABLE',
  'SELECT * FROM VECTOR_SEARCH(TABLE evidence.chunks, TABLE', 'SELECT', 'SELECT 1 FROM evidence.corpus WHERE'][l_linenumber % 8 + 1] || ' ' || p_name AS query,
 trunc(l_extendedprice * 1000000)::BIGINT AS total_bytes_billed, trunc(l_quantity * 1000)::BIGINT AS total_slot_ms
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "replies": """
SELECT event_id::VARCHAR AS row_id, user_id::VARCHAR AS doc_id, event_type,
 CASE WHEN event_id % 7 = 0 THEN split_part(body, ',"records"', 1) WHEN event_id % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw
FROM (SELECT *, '{"label":"' || event_type || '","decision":"' ||
  CASE event_type WHEN 'click' THEN 'include' WHEN 'error' THEN 'exclude' ELSE 'needs_full_text' END || '","criterion":"' || (user_id % 3 + 1) ||
  '","agrees_with_model":' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"confidence":' || printf('0.%02d', event_id % 100) ||
  ',"reason":null,"extra":' || props || ',"records":[{"action":"' || event_type || '","effect_size":' ||
  CASE WHEN user_id % 5 = 0 THEN 'null' ELSE printf('0.%02d', user_id % 100) END || '},{"action":"second","effect_size":"n/a"}]}' AS body FROM events)""",
    "parsed": """
SELECT row_id, doc_id, event_type, CASE WHEN json_valid(t) THEN t::JSON END AS j
FROM (SELECT *, regexp_replace(raw, '```json|```', '', 'g') AS t FROM replies)""",
    "cited_texts": """
SELECT conv_id || '-' || turn AS text_id,
 text || ' [' || (conv_id * 3 + turn) || ' p.' || (turn + 1) || '] and [' ||
 CASE WHEN conv_id % 4 = 0 THEN 'missing-' || turn ELSE conv_id::VARCHAR END || ' p.2].' AS body FROM conversations""",
    "citations": r"""
SELECT text_id, regexp_extract(c, '^\[([^\s\]]+) p\.(\d+)\]$', 1) AS cited_id, regexp_extract(c, '^\[([^\s\]]+) p\.(\d+)\]$', 2)::BIGINT AS page
FROM (SELECT text_id, unnest(regexp_extract_all(body, '\[([^\s\]]+) p\.(\d+)\]')) AS c FROM cited_texts)""",
    "chunks": """
SELECT doc_id::VARCHAR AS doc_id, (j - 1)::BIGINT AS chunk_index, part AS text
FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS part, unnest(range(1, len(string_split(text, '. ')) + 1)) AS j FROM documents)
WHERE trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""",
    "cluster_yearly": """
SELECT cluster_id, make_date(c.year, 1, 1) AS yr, count(*)::BIGINT AS n_docs
FROM clusters k JOIN corpus c ON k.doc_id = c.doc_id WHERE c.year >= 2005 GROUP BY ALL""",
    "gold": """
SELECT task_id, row_id, label, 'human' AS gold_source FROM (
  SELECT * FROM (SELECT task_id, row_id, label, count(*) AS n FROM annotations WHERE source = 'human' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY task_id, row_id ORDER BY n DESC, label) = 1)
UNION ALL
SELECT task_id, row_id, label, 'llm' FROM (SELECT task_id, row_id, label FROM annotations WHERE source = 'llm' AND confidence >= 0.9
  QUALIFY row_number() OVER (PARTITION BY task_id, row_id ORDER BY labeled_at DESC, label_id DESC) = 1) l
WHERE NOT EXISTS (SELECT 1 FROM annotations h WHERE h.source = 'human' AND h.task_id = l.task_id AND h.row_id = l.row_id)""",
}


def sql(body: str) -> str:
    """`body` with every CTE it needs, directly or through another CTE, in dependency order."""
    order: list[str] = []
    open_: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and name not in open_ and re.search(rf"\b{name}\b(?!/)", text):
                open_.add(name)
                visit(CTES[name])
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
