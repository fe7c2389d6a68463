"""Evidence-map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.operators import evidence as op
from siftmap.sources.domain import REGIONS
from siftmap.operators.vector import assign, cluster_quality

TOP = """SELECT cluster_id, region, string_agg(hazard || ':' || n, '|' ORDER BY n DESC, hazard) AS top_hazards FROM (
  SELECT * FROM (SELECT cluster_id, region, hazard, count(*) AS n FROM cells GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY cluster_id, region ORDER BY n DESC, hazard) <= 3) GROUP BY ALL"""
CELLS = """WITH cells AS (SELECT k.cluster_id, coalesce(c.region, m.region, 'Unknown') AS region, c.source_type, coalesce(c.outcome_reported, m.outcome_reported) AS outcome, c.year, c.hazard
  FROM clusters k JOIN corpus c ON k.doc_id = c.doc_id LEFT JOIN metadata m ON m.doc_id = c.doc_id)"""
MAP = f"""{CELLS}
SELECT t.cluster_id, l.label, l.sector, l.evidence_focus, t.region, t.n_docs, round(grey, 3) AS grey_share, round(outcome, 3) AS outcome_share, first_year, last_year, top_hazards
FROM (SELECT cluster_id, region, count(*) AS n_docs, count_if(source_type <> 'peer_reviewed') / count(*) AS grey, count_if(outcome) / count(*) AS outcome,
  min(year) AS first_year, max(year) AS last_year FROM cells GROUP BY ALL) t
JOIN ({TOP}) h ON h.cluster_id = t.cluster_id AND h.region = t.region LEFT JOIN cluster_labels l ON l.cluster_id = t.cluster_id"""


def listed(col: str):
    """An array of (value, count) as text, for comparison."""
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["value"], x["count"].cast("string"))), "|")


def emap(d):
    return op.evidence_map(d.clusters(), d.corpus(), d.cluster_labels(), d.metadata())


def shown(df):
    return (
        df.withColumn("top_hazards", listed("top_hazards"))
        .withColumn("grey_share", F.round("grey_share", 3)).withColumn("outcome_share", F.round("outcome_share", 3))
    )


@query("evidence_map", MAP)
def _(d):
    return shown(emap(d))


@query("evidence_map_bootstrap", """SELECT k.cluster_id, l.label, l.sector, l.evidence_focus, coalesce(c.region, 'Unknown') AS region, count(*) AS n_docs,
 round(count_if(c.source_type <> 'peer_reviewed') / count(*), 3) AS grey_share, round(count_if(c.outcome_reported) / count(*), 3) AS outcome_share,
 min(c.year) AS first_year, max(c.year) AS last_year, 'Not enriched:' || count(*) AS top_hazards
FROM clusters k JOIN corpus c ON k.doc_id = c.doc_id JOIN cluster_labels l ON l.cluster_id = k.cluster_id GROUP BY ALL""")
def _(d):
    return shown(op.evidence_map_plain(d.clusters(), d.corpus(), d.cluster_labels()))


@query("evidence_map_sorted", MAP + " ORDER BY t.cluster_id, t.region")
def _(d):
    return shown(emap(d)).orderBy("cluster_id", "region")


@query("evidence_map_regions", f"SELECT DISTINCT region FROM ({MAP})")
def _(d):
    return emap(d).select("region").distinct().orderBy("region")


@query("top_k_values", """SELECT region, string_agg(coalesce(hazard || ':', '') || n, '|' ORDER BY n DESC, hazard NULLS LAST) AS top_hazard FROM (
  SELECT * FROM (SELECT coalesce(region, 'Unknown') AS region, nullif(hazard, 'hazard_3') AS hazard, count(*) AS n FROM corpus GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, hazard NULLS LAST) <= 3) GROUP BY region""")
def _(d):
    c = d.corpus().select(F.coalesce("region", F.lit("Unknown")).alias("region"), F.nullif("hazard", F.lit("hazard_3")).alias("hazard"))
    return op.top_values(c, ["region"], "hazard", 3).withColumn("top_hazard", listed("top_hazard"))


@query("cluster_top_titles", """SELECT cluster_id, string_agg(title, chr(10) ORDER BY rn) FILTER (WHERE rn <= 12) AS titles, count(*) AS n_docs FROM (
 SELECT k.cluster_id, c.title, row_number() OVER (PARTITION BY k.cluster_id ORDER BY round(k.dist_to_centroid, 9), k.doc_id) AS rn
 FROM doc_clusters k JOIN corpus c ON k.doc_id = c.doc_id) GROUP BY cluster_id""")
def _(d):
    near = assign(d.clustered(), op.centroids(d.clustered())).withColumn("dist_to_centroid", F.round("dist_to_centroid", 9))
    return op.top_titles(near, d.corpus())


@query("cluster_documents", """SELECT k.doc_id, title, year, region, source_type, evidence_type, round(dist_to_centroid, 4) AS dist_to_centroid
FROM doc_clusters k JOIN corpus c ON k.doc_id = c.doc_id WHERE cluster_id = 3 ORDER BY round(k.dist_to_centroid, 9), k.doc_id LIMIT 30""")
def _(d):
    near = assign(d.clustered(), op.centroids(d.clustered())).withColumn("dist_to_centroid", F.round("dist_to_centroid", 9))
    return op.cluster_documents(near, d.corpus(), 3)


PIVOT_REGIONS = [*REGIONS, "Global", "Unknown"]


@query("evidence_map_pivot", f"""WITH per AS (SELECT k.cluster_id, coalesce(c.region, m.region, 'Unknown') AS region, count(*) AS n FROM clusters k JOIN corpus c ON k.doc_id = c.doc_id
  LEFT JOIN metadata m ON m.doc_id = c.doc_id GROUP BY ALL)
SELECT cluster_id, {", ".join(f'''max(CASE WHEN region = '{r}' THEN n END)::BIGINT AS "{r}_n", round(max(CASE WHEN region = '{r}' THEN ln(1 + n) / ln(1 + (SELECT greatest(1, max(n)) FROM per)) END), 6) AS "{r}_shade"''' for r in PIVOT_REGIONS)}
FROM per GROUP BY cluster_id""")
def _(d):
    p = op.pivot(emap(d).select("cluster_id", "region", "n_docs"), PIVOT_REGIONS)
    return p.select("cluster_id", *[F.round(f"`{c}`", 6).alias(c) if c.endswith("_shade") else F.col(f"`{c}`") for c in p.columns[1:]])


@query("cluster_coherence", """WITH sp AS (SELECT c.cluster_id, c.centroid, avg(k.dist_to_centroid) AS s FROM doc_clusters k JOIN centroids c ON k.cluster_id = c.cluster_id GROUP BY ALL),
 q AS (SELECT avg(r) AS dbi FROM (
  SELECT a.cluster_id, max((a.s + b.s) / (1 - list_cosine_similarity(a.centroid, b.centroid))) AS r FROM sp a JOIN sp b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id))
SELECT l.cluster_id, l.label, l.coherence_guess, count_if(d.decision_type = 'cluster_coherent')::BIGINT AS votes_coherent, count_if(d.decision_type = 'cluster_incoherent')::BIGINT AS votes_incoherent,
 round((SELECT dbi FROM q), 6) AS davies_bouldin
FROM cluster_labels l LEFT JOIN decisions d ON d.cluster_id = l.cluster_id GROUP BY ALL""")
def _(d):
    c = op.centroids(d.clustered())
    dbi = cluster_quality(assign(d.clustered(), c), c)
    return op.coherence(d.cluster_labels(), d.decisions(), dbi).withColumn("davies_bouldin", F.round("davies_bouldin", 6))
