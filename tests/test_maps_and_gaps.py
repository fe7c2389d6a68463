import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmap.operators import evidence, gaps

CORPUS = "doc_id string, title string, region string, source_type string, language string, sector string, hazard string, evidence_type string, outcome_reported boolean, year int"


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(
        [
            ("1", "t1", "Asia", "peer_reviewed", "en", "s1", "flood", "adaptation", True, 2010),
            ("2", "t2", "Asia", "news", "fr", "s1", None, "impact", None, 2015),
            ("3", "t3", None, "news", "en", None, None, "impact", True, None),
            ("4", "t4", None, "preprint", "de", None, "heat", "maladaptation", None, 2020),
        ],
        CORPUS,
    )


@pytest.fixture
def meta(spark):
    return spark.createDataFrame([("4", "Africa", "s9", True)], "doc_id string, region string, sector string, outcome_reported boolean")


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([("1", 0.9), ("2", 0.5), ("3", 0.6), ("4", 0.8)], "doc_id string, p_relevant double")


@pytest.fixture
def expected(spark):
    return gaps.expected_shares(spark, [("Asia", 0.4), ("Africa", 0.2), ("Polar Regions", 0.01)])


def test_missing_region_counts_in_the_total_only(corpus, scores, meta, expected):
    got = {r.region: r for r in gaps.by_region(corpus, scores, meta, expected).collect()}
    assert got["Asia"].n_docs == 2 and got["Asia"].observed_share == 0.5
    assert got["Africa"].n_docs == 1 and got["Africa"].observed_share == 0.25
    assert got["Polar Regions"].n_docs == 0 and got["Polar Regions"].grey_share is None and got["Polar Regions"].coverage_ratio == 0.0


def test_outcome_share_may_exceed_one(spark, corpus, scores, meta, expected):
    more = corpus.withColumn("outcome_reported", F.lit(True))
    got = {r.region: r.adaptation_with_outcome_share for r in gaps.by_region(more, scores, meta, expected).collect()}
    assert got["Asia"] == 2.0


def test_nothing_relevant(corpus, scores, meta, expected):
    got = gaps.by_region(corpus, scores.withColumn("p_relevant", F.lit(0.1)), meta, expected)
    assert {(r.n_docs, r.observed_share) for r in got.collect()} == {(0, None)}
    assert gaps.gini(got).head().gini_region is None


def test_gini_of_even_and_single(spark):
    even = spark.createDataFrame([("a", 5), ("b", 5)], "region string, n_docs bigint")
    single = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 8)], "region string, n_docs bigint")
    assert gaps.gini(even).head().gini_region == 0.0
    assert gaps.gini(single).head().gini_region == 0.75


def test_single_study_has_no_deviation(spark):
    o = spark.createDataFrame([("k", "t", "positive", 0.5)], "context_similarity_key string, adaptation_type string, outcome_direction string, effect_size double")
    r = gaps.outcome_summary(o).head()
    assert (r.n_positive, r.n_negative, r.mean_effect, r.sd_effect) == (1, 0, 0.5, None)


def test_merge_never_changes_existing_rows(spark, rows):
    t = spark.createDataFrame([("Asia", 0.9)], "region string, expected_share double")
    s = spark.createDataFrame([("Asia", 0.4), ("Africa", 0.2)], "region string, expected_share double")
    assert rows(gaps.merge_absent(t, s, "region")) == [("Africa", 0.2), ("Asia", 0.9)]


def test_top_values_count_null_and_break_ties(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "b"), ("k", "a"), ("k", "a"), ("k", None), ("k", None), ("k", None), ("k", "z")], "k string, v string")
    got = evidence.top_values(df, ["k"], "v", 3).head().top_v
    assert [(x["value"], x["count"]) for x in got] == [(None, 3), ("a", 2), ("b", 2)]


def test_map_cell(spark, corpus, meta):
    clusters = spark.createDataFrame([(str(i), 1) for i in range(1, 5)], "doc_id string, cluster_id bigint")
    labels = spark.createDataFrame([], "cluster_id bigint, label string, sector string, evidence_focus string")
    got = {r.region: r for r in evidence.evidence_map(clusters, corpus, labels, meta).collect()}
    assert set(got) == {"Asia", "Africa", "Unknown"}
    assert got["Asia"].grey_share == 0.5 and got["Asia"].outcome_share == 0.5 and got["Asia"].first_year == 2010 and got["Asia"].label is None
    assert got["Africa"].outcome_share == 1.0
    assert [(h["value"], h["count"]) for h in got["Asia"].top_hazards] == [("flood", 1), (None, 1)]
    # without enrichment only labelled clusters appear
    assert evidence.evidence_map_plain(clusters, corpus, labels).count() == 0


def test_centroids_match_numpy(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(50, 8))
    df = spark.createDataFrame([(str(i), int(i % 3), [float(x) for x in v]) for i, v in enumerate(m)], "doc_id string, cluster_id bigint, embedding array<double>")
    for row in evidence.centroids(df).collect():
        assert np.allclose(row.centroid, m[np.arange(50) % 3 == row.cluster_id].mean(axis=0))


def test_coherence_keeps_clusters_without_votes(spark, rows):
    labels = spark.createDataFrame([(1, "a", "high"), (2, "b", "low")], "cluster_id bigint, label string, coherence_guess string")
    votes = spark.createDataFrame([(1, "cluster_coherent"), (1, "cluster_incoherent"), (1, "cluster_coherent")], "cluster_id bigint, decision_type string")
    assert rows(evidence.coherence(labels, votes), "cluster_id", "votes_coherent", "votes_incoherent") == [(1, 2, 1), (2, 0, 0)]
