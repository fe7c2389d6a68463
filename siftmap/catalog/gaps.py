"""Coverage-gap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.catalog.screening import predictions
from siftmap.operators import gaps as op
from siftmap.sources.domain import REGION_EXPECTED_SHARE

# one row per region first, shares of it afterwards; a region without documents keeps the zeros of the outer join
TALLY = """tally AS (SELECT place, count(*) AS docs, sum((source_type <> 'peer_reviewed')::INTEGER) AS grey, sum((language <> 'en')::INTEGER) AS abroad, sum(adaptive) AS adaptive,
  sum(outcome_reported::INTEGER) AS outcomes FROM relevant GROUP BY place), everything AS (SELECT count(*)::DOUBLE AS docs FROM relevant)
SELECT expected.region, coalesce(docs, 0)::BIGINT AS n_docs, expected_share, CASE WHEN total > 0 THEN coalesce(docs, 0) / total END AS observed_share,
 CASE WHEN total > 0 THEN coalesce(docs, 0) / total / expected_share END AS coverage_ratio, coalesce(grey, 0) / docs AS grey_share, coalesce(abroad, 0) / docs AS non_english_share, {more}
FROM expected LEFT JOIN tally ON place = expected.region, (SELECT docs AS total FROM everything)"""
FULL = """WITH relevant AS (SELECT coalesce(c.region, m.region) AS place, source_type, language, c.outcome_reported, (c.evidence_type = 'adaptation' OR c.evidence_type = 'maladaptation')::INTEGER AS adaptive
 FROM corpus c SEMI JOIN (SELECT doc_id FROM scores WHERE p_relevant >= 0.5) k ON k.doc_id = c.doc_id LEFT JOIN metadata m ON m.doc_id = c.doc_id), """ + TALLY.format(
    more="coalesce(adaptive, 0) / docs AS adaptation_share, CASE WHEN adaptive > 0 THEN coalesce(outcomes, 0) / adaptive END AS adaptation_with_outcome_share")
PLAIN = """WITH relevant AS (SELECT region AS place, source_type, language, NULL::BOOLEAN AS outcome_reported, NULL::INTEGER AS adaptive FROM predictions WHERE p_relevant >= 0.5), """ + TALLY.format(
    more="NULL::DOUBLE AS adaptation_share, NULL::DOUBLE AS adaptation_with_outcome_share")
RATIOS = ["observed_share", "coverage_ratio", "grey_share", "non_english_share", "adaptation_share", "adaptation_with_outcome_share"]


def rounded(sql: str) -> str:
    return f"SELECT region, n_docs, expected_share, {', '.join(f'round({c}, 6) AS {c}' for c in RATIOS)} FROM ({sql})"


def show(df):
    return df.select("region", "n_docs", "expected_share", *[F.round(c, 6).alias(c) for c in RATIOS])


def expected(d):
    return op.expected_shares(d.spark, REGION_EXPECTED_SHARE)


def full(d):
    return op.by_region(d.corpus(), d.scores(), d.metadata(), expected(d))


@query("gap_by_region", rounded(FULL))
def _(d):
    return show(full(d))


@query("gap_by_region_bootstrap", rounded(PLAIN))
def _(d):
    return show(op.by_region_plain(predictions(d), expected(d)))


@query("gap_region_sector", """SELECT coalesce(c.region, m.region, 'Unknown') AS region, coalesce(c.sector, m.sector, 'Unknown') AS sector, count(*) AS n_docs,
 count_if(c.evidence_type = 'adaptation')::BIGINT AS n_adaptation, count_if(c.evidence_type = 'maladaptation')::BIGINT AS n_maladaptation, count_if(c.outcome_reported)::BIGINT AS n_with_outcome
FROM corpus c JOIN scores s ON c.doc_id = s.doc_id LEFT JOIN metadata m ON m.doc_id = c.doc_id WHERE s.p_relevant >= 0.5 GROUP BY ALL""")
def _(d):
    return op.region_sector(d.corpus(), d.scores(), d.metadata())


@query("gap_region_sector_bootstrap", """SELECT region, 'Not enriched' AS sector, count(*) AS n_docs, 0::BIGINT AS n_adaptation, 0::BIGINT AS n_maladaptation, 0::BIGINT AS n_with_outcome
FROM predictions WHERE p_relevant >= 0.5 GROUP BY region""")
def _(d):
    return op.region_sector_plain(predictions(d))


@query("gini_ranked", f"""SELECT x.region, x.n_docs AS docs, count(y.region) AS position, (SELECT count(*) FROM ({FULL})) AS regions, (SELECT sum(n_docs) FROM ({FULL}))::BIGINT AS total
FROM ({FULL}) x JOIN ({FULL}) y ON (y.n_docs, y.region) <= (x.n_docs, x.region) GROUP BY x.region, x.n_docs""")
def _(d):
    return op.ranked_counts(full(d))


# mean absolute difference of all pairs of regions, over twice their mean
@query("gap_gini", f"""SELECT CASE WHEN sum(x.n_docs) > 0 THEN round(sum(abs(x.n_docs - y.n_docs))::DOUBLE / 2 / sum(x.n_docs)::DOUBLE, 4) END AS gini_region FROM ({FULL}) x, ({FULL}) y""")
def _(d):
    return op.gini(full(d))


@query("under_covered_regions", f"SELECT region, round(coverage_ratio, 6) AS coverage_ratio FROM ({FULL}) WHERE coalesce(coverage_ratio, 1) < 0.6")
def _(d):
    return op.under_covered(full(d)).select("region", F.round("coverage_ratio", 6).alias("coverage_ratio"))


OUTCOMES = """SELECT context_similarity_key, adaptation_type, count(*) AS n_studies, count_if(outcome_direction = 'positive')::BIGINT AS n_positive,
 count_if(outcome_direction = 'negative')::BIGINT AS n_negative, count_if(outcome_direction = 'mixed')::BIGINT AS n_mixed, round(avg(effect_size), 6) AS mean_effect, round(stddev_samp(effect_size), 6) AS sd_effect
FROM outcomes GROUP BY ALL"""


def summary(d):
    return op.outcome_summary(d.outcomes()).withColumn("mean_effect", F.round("mean_effect", 6)).withColumn("sd_effect", F.round("sd_effect", 6))


@query("adaptation_outcome_summary", OUTCOMES)
def _(d):
    return summary(d)


@query("outcomes_top40", OUTCOMES + " ORDER BY n_studies DESC, context_similarity_key, adaptation_type LIMIT 40")
def _(d):
    return summary(d).orderBy(F.desc("n_studies"), "context_similarity_key", "adaptation_type").limit(40)


@query("bias_share_report", """SELECT 'region' AS kind, region AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM corpus WHERE evidence_type <> 'off_topic' GROUP BY region
UNION ALL SELECT 'language', language, count(*), round(count(*) / sum(count(*)) OVER (), 3) FROM corpus GROUP BY language""")
def _(d):
    return op.share_report(d.corpus()).withColumn("share", F.round("share", 3))


@query("merge_insert_absent", """WITH seen AS (SELECT region, count(*) / (SELECT count(*) FROM corpus) AS share FROM corpus WHERE region IS NOT NULL AND source_type = 'news' GROUP BY region HAVING count(*) > 3)
SELECT region, round(share, 6) AS expected_share FROM seen UNION ALL SELECT region, expected_share FROM expected e WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.region = e.region)""")
def _(d):
    n = d.corpus().agg(F.count(F.lit(1))).scalar()
    seen = (
        d.corpus().filter("region IS NOT NULL AND source_type = 'news'").groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
        .select("region", F.round(F.col("n") / n, 6).alias("expected_share"))
    )
    return op.merge_absent(seen, expected(d), "region")


@query("inline_values", """SELECT e.region, e.expected_share, count(c.doc_id) AS n_docs FROM expected e LEFT JOIN corpus c ON c.region = e.region GROUP BY ALL""")
def _(d):
    n = d.corpus().groupBy("region").agg(F.count(F.lit(1)).alias("n_docs"))
    return expected(d).join(n, "region", "left").fillna(0, ["n_docs"])


@query("join_dim_preserving", """SELECT e.region, count(c.doc_id) AS n_docs FROM expected e LEFT JOIN (SELECT * FROM corpus WHERE source_type = 'ngo_report' AND language = 'de') c ON c.region = e.region GROUP BY ALL""")
def _(d):
    n = d.corpus().filter("source_type = 'ngo_report' AND language = 'de'").groupBy("region").agg(F.count(F.lit(1)).alias("n_docs"))
    return expected(d).select("region").join(n, "region", "left").fillna(0, ["n_docs"])
