import pytest
from pyspark.sql import functions as F

from siftmap.operators import monitoring
from siftmap.operators import registry as op


def evals(spark, *metrics):
    return spark.createDataFrame([(str(i), m) for i, m in enumerate(metrics)], "eval_id string, metrics_json string")


@pytest.mark.parametrize(
    "metrics,gates,passed",
    [
        ('{"recall": 0.9, "roc_auc": 0.9}', {"recall": 0.85, "roc_auc": 0.85}, True),
        ('{"recall": 0.9, "roc_auc": 0.8}', {"recall": 0.85, "roc_auc": 0.85}, False),
        ('{"recall": 0.9}', {"recall": 0.85, "roc_auc": 0.85}, True),
        ('{"other": 1}', {"recall": 0.85}, False),
        ('{"dbi": 1.5}', {"dbi_max": 1.5}, True),
        ('{"dbi": 1.6}', {"dbi_max": 1.5}, False),
        ('{"recall": 0.9}', {}, None),
        ("broken", {"recall": 0.85}, False),
        (None, {"recall": 0.85}, False),
    ],
)
def test_gates(spark, metrics, gates, passed):
    assert op.check_gates(evals(spark, metrics), gates).head().passed is passed


def promoted(spark, requests, evaluated=(("a", 0), ("b", 0))):
    models = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("x", "u")], "model_id string, task string")
    ev = spark.createDataFrame(list(evaluated), "model_id string, evaluated_at int")
    rq = spark.createDataFrame(
        [(f"p{i:02d}", m, s, r, i + 1) for i, (m, s, r) in enumerate(requests)], "promotion_id string, model_id string, to_stage string, reason string, promoted_at int"
    )
    acc = op.accepted_promotions(rq, models, ev)
    return {r.model_id: r.stage for r in op.model_stages(models, acc).collect()}


def test_second_production_model_moves_the_first_to_staging(spark):
    assert promoted(spark, [("a", "production", "r"), ("b", "production", "r")]) == {"a": "staging", "b": "production", "c": "candidate", "x": "candidate"}


def test_the_first_model_stays_staged_when_the_second_retires(spark):
    got = promoted(spark, [("a", "production", "r"), ("b", "production", "r"), ("b", "retired", "r")])
    assert (got["a"], got["b"]) == ("staging", "retired")


def test_back_to_production(spark):
    got = promoted(spark, [("a", "production", "r"), ("b", "production", "r"), ("a", "production", "r")])
    assert (got["a"], got["b"]) == ("production", "staging")


def test_refused_promotions(spark):
    got = promoted(spark, [("c", "production", "no evaluation"), ("a", "staging", "  "), ("b", "archived", "r"), ("nobody", "retired", "r"), ("c", "retired", "r")])
    assert got == {"a": "candidate", "b": "candidate", "c": "retired", "x": "candidate"}


def test_an_evaluation_must_come_first(spark):
    assert promoted(spark, [("c", "staging", "r")], evaluated=[("c", 5)])["c"] == "candidate"
    assert promoted(spark, [("c", "staging", "r")], evaluated=[("c", 1)])["c"] == "staging"


def test_first_matching_kind_wins(spark):
    q = spark.createDataFrame([("ML.GENERATE_TEXT VECTOR_SEARCH",), ("CREATE MODEL x",), ("CREATE OR REPLACE MODEL x",), ("ML.EVALUATE",), ("mlXpredict",)], "q string")
    assert [r[0] for r in q.select(monitoring.classify("q")).collect()] == ["llm_generate_text", "train_model", "train_model", "predict", "other"]


def test_every_decision_counts_in_the_override_rate(spark):
    d = spark.createDataFrame([("a", "screen_include"), ("a", "screen_include"), ("b", "screen_exclude"), ("b", "citation_ok"), ("gone", "screen_include")], "doc_id string, decision_type string")
    s = spark.createDataFrame([("a", 0.2), ("b", 0.1)], "doc_id string, p_relevant double")
    r = monitoring.override_rate(d, s).head()
    assert (round(r.override_rate, 6), r.n_decisions) == (0.666667, 3)
    none = monitoring.override_rate(d.limit(0), s).head()
    assert none.override_rate is None and none.n_decisions == 0


def test_psi(spark):
    same = spark.createDataFrame([(0.05, True), (0.95, True)] * 5, "p_relevant double, t boolean")
    assert monitoring.psi(same, F.col("t")).head().psi == 0.0
    moved = spark.createDataFrame([(0.05, True)] * 5 + [(0.95, False)] * 5, "p_relevant double, t boolean")
    r = monitoring.psi(moved, F.col("t")).head()
    assert r.psi > 0.2 and r.drifted
    overrides = spark.createDataFrame([(0.1, 10)], "override_rate double, n_decisions bigint")
    assert monitoring.drift_alert(overrides, monitoring.psi(moved, F.col("t"))).head().action == "label more"
    assert monitoring.drift_alert(overrides, monitoring.psi(same, F.col("t"))).head().action == "none"


def test_ledger_window(spark):
    j = spark.sql("SELECT timestamp_ntz'2024-03-31 12:00' AS creation_time, 'evidence' AS query, 1073741824L AS total_bytes_billed, 3600000L AS total_slot_ms "
                  "UNION ALL SELECT timestamp_ntz'2024-03-01 12:00', 'evidence', 0L, 0L UNION ALL SELECT timestamp_ntz'2024-03-01 11:59', 'evidence', 0L, 0L "
                  "UNION ALL SELECT timestamp_ntz'2024-03-31 11:00', 'elsewhere', 0L, 0L")
    got = {str(r.day): r for r in monitoring.cost_ledger(j, "evidence").collect()}
    assert set(got) == {"2024-03-31", "2024-03-01"}
    assert got["2024-03-01"].n_jobs == 1 and got["2024-03-31"].gb_billed == 1.0 and got["2024-03-31"].slot_hours == 1.0
