import datetime as dt

from siftmap.sources.domain import DECISION_TYPES
from siftmap.streaming import decisions as st

SCHEMA = "decision_id string, doc_id string, cluster_id bigint, decision_type string, reviewer string, note string, decided_at timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def put(spark, path, *rows):
    spark.createDataFrame([(i, d, None, k, "r", None, t) for i, d, k, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ingest_drops_repeats_and_rule_breakers_across_runs(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, src, ("1", "a", "screen_include", at(1)), ("1", "a", "screen_include", at(1)), ("2", None, "screen_include", at(1)), ("3", "a", "odd", at(1)))
    st.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    put(spark, src, ("1", "a", "screen_include", at(1, 1)), ("4", "b", "citation_ok", at(1, 2)))
    st.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    assert sorted(r.decision_id for r in spark.read.parquet(out).collect()) == ["1", "4"]


def test_late_decisions_are_kept(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, src, ("1", "a", "screen_include", at(20)))
    st.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    put(spark, src, ("2", "a", "screen_include", at(12)), ("1", "a", "screen_include", at(20)))
    st.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    assert sorted(r.decision_id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_latest_equals_batch_over_several_runs(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, src, ("1", "a", "screen_include", at(1)), ("2", "b", "screen_exclude", at(1)))
    st.latest_per_document(stream(spark, src), out, cp)
    put(spark, src, ("3", "a", "screen_exclude", at(2)), ("4", "b", "screen_include", at(1) - dt.timedelta(hours=1)), ("5", "c", "citation_ok", at(3)))
    st.latest_per_document(stream(spark, src), out, cp)
    got = {r.doc_id: r.human_decision for r in st.current(spark, out).collect()}
    assert got == {"a": "screen_exclude", "b": "screen_exclude"}


def test_days_add_up_over_runs_and_late_rows(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    scores = spark.createDataFrame([("a", 0.9)], "doc_id string, p_relevant double")
    put(spark, src, ("1", "a", "screen_exclude", at(1)), ("2", "a", "screen_include", at(1)), ("3", "a", "screen_include", at(5)))
    st.daily_counts(stream(spark, src), out, cp)
    put(spark, src, ("4", "b", "screen_include", at(1)))
    st.daily_counts(stream(spark, src), out, cp)
    got = {(r.day.day, r.decision_type): (r.n, r.n_override) for r in st.daily_report(spark.read.parquet(out), scores).collect()}
    assert got == {(1, "screen_exclude"): (1, 1), (1, "screen_include"): (2, 0), (5, "screen_include"): (1, 0)}


def test_compacted_batches_read_the_same(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    for k in range(3):
        put(spark, src, (str(k), "a", "screen_include" if k else "screen_exclude", at(3 - k)), (f"b{k}", f"b{k}", "screen_exclude", at(1)))
        st.latest_per_document(stream(spark, src), out, cp)
    st.compact(spark, out, f"{tmp_path}/small")
    rows = lambda p: sorted(tuple(r) for r in st.current(spark, p).collect())
    assert rows(out) == rows(f"{tmp_path}/small") and ("a", "screen_exclude") in rows(out)
