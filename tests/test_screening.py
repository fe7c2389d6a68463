import pytest

from siftmap.operators import screening as op
from siftmap.sources.domain import DECISION_TYPES


def test_vote_tie_is_relevant_and_splits_stay_apart(spark, rows):
    labels = spark.createDataFrame([("a", 0, "train"), ("a", 1, "train"), ("a", 0, "test"), ("b", 0, "train")], "doc_id string, label int, split string")
    assert rows(op.majority_vote(labels)) == [("a", "test", 0), ("a", "train", 1), ("b", "train", 0)]


def test_equal_scores_share_a_rank(spark, rows):
    s = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", 0.1)], "doc_id string, p_relevant double")
    assert rows(op.rank_predictions(s, depth=2), "doc_id", "priority_rank") == [("a", 1), ("b", 2), ("c", 2), ("d", 4)]


def test_remaining_is_zero_at_the_end(spark):
    s = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.1)], "doc_id string, p_relevant double")
    left = [round(r.expected_relevant_remaining, 9) for r in op.rank_predictions(s).orderBy("priority_rank").collect()]
    assert left == [0.6, 0.1, 0.0]


def test_stop_rank_without_a_qualifying_row(spark):
    s = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "doc_id string, p_relevant double")
    ranked = op.rank_predictions(s)
    one = op.stopping_point(ranked, fraction=0.0).collect()
    assert len(one) == 1 and one[0].suggested_stop_rank is None and one[0].corpus_size == 2
    assert op.stopping_point_grouped(ranked, fraction=0.0).count() == 0


def test_recall_curve_without_relevant_documents(spark):
    gold = spark.createDataFrame([("a", 0), ("b", 0)], "doc_id string, label int")
    s = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "doc_id string, p_relevant double")
    curve = op.recall_curve(gold, s)
    assert [r.recall_at_k for r in curve.collect()] == [None, None]
    assert op.work_saved(curve).head().wss_at_95 is None


def test_band_includes_both_ends(spark, rows):
    p = spark.createDataFrame([("a", 0.3, False), ("b", 0.7, False), ("c", 0.5, True), ("d", 0.71, False)], "doc_id string, p_relevant double, already_labelled boolean")
    assert rows(op.uncertain_band(p), "doc_id") == [("a",), ("b",)]


def test_latest_decision_ties_by_id_and_ignores_other_kinds(spark, rows):
    d = spark.createDataFrame(
        [("1", "a", "screen_include", 5), ("2", "a", "screen_exclude", 5), ("3", "a", "citation_ok", 9), ("4", "b", "screen_include", 1)],
        "decision_id string, doc_id string, decision_type string, decided_at int",
    )
    assert rows(op.latest_decision(d)) == [("a", "screen_exclude"), ("b", "screen_include")]


@pytest.mark.parametrize("limit,offset", [(0, 0), (201, 0), (10, -1)])
def test_page_bounds(spark, limit, offset):
    with pytest.raises(ValueError):
        op.queue_page(None, None, None, limit=limit, offset=offset)


def test_decision_rules(spark):
    cases = [
        ("1", None, None, "screen_include", "r", None, "doc_id or cluster_id required"),
        ("2", "a", None, "nope", "r", None, "unknown decision_type"),
        ("3", "a", None, None, "r", None, "unknown decision_type"),
        ("4", "a", None, "citation_ok", "", None, "reviewer must have 1 to 120 characters"),
        ("5", "a", None, "citation_ok", None, None, "reviewer must have 1 to 120 characters"),
        ("6", "a", None, "citation_ok", "x" * 121, None, "reviewer must have 1 to 120 characters"),
        ("7", "a", None, "citation_ok", "r", "n" * 1001, "note longer than 1000 characters"),
        ("8", None, 3, "cluster_coherent", "r" * 120, "n" * 1000, None),
    ]
    df = spark.createDataFrame([c[:6] for c in cases], "decision_id string, doc_id string, cluster_id bigint, decision_type string, reviewer string, note string")
    got = {r.decision_id: r.rejected_because for r in op.validate_decisions(df, DECISION_TYPES).collect()}
    assert got == {c[0]: c[6] for c in cases}


def test_agreement_of_nothing_is_null(spark):
    none = spark.createDataFrame([], "agrees_with_model boolean, llm_decision string")
    r = op.agreement(none).head()
    assert r.n_band == 0 and r.llm_model_agreement is None
