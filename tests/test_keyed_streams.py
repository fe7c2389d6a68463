import collections
import datetime as dt
import random

import pytest

from siftmap.sources.domain import DECISION_TYPES
from siftmap.streaming import decisions as st
from siftmap.streaming import keyed

SCHEMA = "decision_id string, doc_id string, cluster_id bigint, decision_type string, reviewer string, note string, decided_at timestamp"


def put(spark, path, rows):
    spark.createDataFrame([(i, d, None, k, "r", None, t) for i, d, k, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def made(seed, batches):
    rng = random.Random(seed)
    out, n = [], 0
    for _ in range(batches):
        rows = []
        for _ in range(5):
            n += 1
            when = dt.datetime(2024, 1, rng.randrange(1, 9), rng.randrange(24))
            rows.append((f"{n:04}", rng.choice("abcdef"), rng.choice(["screen_include", "screen_exclude", "citation_ok"]), when))
        out.append(rows)
    return out


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_cover_holds_every_batch_once(fan):
    for n in range(70):
        seen = [b for level, upto in keyed.cover(n, fan) for b in range(upto - fan**level + 1, upto + 1)]
        assert seen == list(range(n)) and all((upto + 1) % fan**level == 0 for level, upto in keyed.cover(n, fan))
        assert max(collections.Counter(level for level, _ in keyed.cover(n, fan)).values(), default=0) < fan


def test_equal_to_all_rows_over_many_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FAN", 2)
    monkeypatch.setattr(keyed.write_segment, "__defaults__", (2,))
    monkeypatch.setattr(keyed.read_segments, "__defaults__", (2,))
    src, late, days = f"{tmp_path}/in", f"{tmp_path}/latest", f"{tmp_path}/days"
    scores = spark.createDataFrame([(c, 0.1 * k) for k, c in enumerate("abcdef", 2)], "doc_id string, p_relevant double")
    given = []
    for rows in made(3, 5):
        given += rows
        put(spark, src, rows)
        keyed.latest(stream(spark, src), late, f"{tmp_path}/c1")
        keyed.daily(stream(spark, src), days, f"{tmp_path}/c2")
    want = {}
    for i, d, k, t in sorted(given, key=lambda r: (r[3], r[0])):
        if k.startswith("screen_"):
            want[d] = k
    assert {r.doc_id: r.human_decision for r in keyed.current(spark, late).collect()} == want
    counts = collections.Counter((t.date(), d, k) for _, d, k, t in given)
    assert {(r.day, r.doc_id, r.decision_type): r.n for r in keyed.daily_totals(spark, days).collect()} == counts
    assert sum(r.n for r in st.daily_report(keyed.daily_totals(spark, days), scores).collect()) == len(given)
    # five batches are read from one segment of four and one of one
    assert keyed.cover(5, 2) == [(2, 3), (0, 4)] and len(spark.read.parquet(f"{late}/level=2/upto=3").collect()) <= 6


def test_ids_are_remembered_however_late(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, src, [("1", "a", "screen_include", dt.datetime(2024, 5, 1)), ("1", "a", "screen_include", dt.datetime(2024, 5, 1)), ("2", None, "screen_include", dt.datetime(2024, 5, 1))])
    keyed.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    put(spark, src, [("3", "b", "citation_ok", dt.datetime(2020, 1, 1)), ("1", "a", "screen_include", dt.datetime(2019, 5, 1)), ("4", "b", "odd", dt.datetime(2024, 5, 1))])
    keyed.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    keyed.ingest(stream(spark, src), DECISION_TYPES, out, cp)
    assert sorted(r.decision_id for r in spark.read.schema(SCHEMA).parquet(out).collect()) == ["1", "3"]


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    """Rows that a later batch reads do not grow with those before it."""
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    sizes = []
    for rows in made(5, 3):
        put(spark, src, rows)
        query = stream(spark, src).groupBy("doc_id").count().writeStream.outputMode("update").foreachBatch(lambda b, k: keyed.write_segment(b, k, out, ["doc_id"]))
        query = query.option("checkpointLocation", cp).trigger(availableNow=True).start()
        st.drain(query)
        sizes.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert sizes == [5, 5, 5]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    one = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, n bigint")
    two = spark.createDataFrame([("a", 2)], "doc_id string, n bigint")
    for frame, k in ((one, 0), (two, 1), (two, 1), (one.limit(0), 2)):
        keyed.write_segment(frame, k, out, ["doc_id"], 2)
    assert sorted(map(tuple, keyed.read_segments(spark, out, "doc_id string, n bigint", ["doc_id"], 2).collect())) == [("a", 2), ("b", 1)]
