import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftmap.operators import labeling as op

SCHEMA = "label_id string, task_id string, row_id string, label string, source string, annotator string, confidence double, rationale string, labeled_at int"


def frame(spark, rows):
    full = [(str(i), "t", r, lab, src, who, conf, None, i) for i, (r, lab, src, who, conf) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_gold_rules(spark, rows):
    labels = frame(spark, [
        ("a", "y", "human", "A", 1.0), ("a", "x", "human", "B", 1.0),  # tie: the smaller label
        ("a", "z", "llm", "m", 0.99),  # a human label wins over any model label
        ("b", "x", "llm", "m", 0.9), ("c", "x", "llm", "m", 0.89),
        ("d", "x", "llm", "m", 0.95), ("d", "y", "llm", "m", 0.95),  # the newest model label
    ])
    assert rows(op.gold(labels)) == [("t", "a", "x", "human"), ("t", "b", "x", "llm"), ("t", "d", "y", "llm")]
    assert rows(op.gold(labels, floor=2.0)) == [("t", "a", "x", "human")]


def test_tasks_on_the_same_row_stay_apart(spark, rows):
    data = [("1", "t1", "a", "relevant", "human", "A"), ("2", "t1", "a", "relevant", "human", "B"), ("3", "t2", "a", "flood", "human", "A"),
            ("4", "t2", "a", "flood", "llm", "m"), ("5", "t1", "a", "other", "llm", "m"), ("6", "t3", "b", "x", "llm", "m")]
    labels = spark.createDataFrame([(i, t, r, lab, s, who, 0.95, None, int(i)) for i, t, r, lab, s, who in data], SCHEMA)
    assert rows(op.gold(labels)) == [("t1", "a", "relevant", "human"), ("t2", "a", "flood", "human"), ("t3", "b", "x", "llm")]
    assert rows(op.agreement(labels)) == [("t1", 1.0, 1, 0.0), ("t2", None, 0, 1.0), ("t3", None, 0, None)]
    assert rows(op.model_labels(labels), "task_id", "llm_label") == [("t1", "other"), ("t2", "flood"), ("t3", "x")]
    assert rows(op.distribution(labels))[0] == ("t1", "other", "llm", 1)
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "row_id string")
    assert rows(op.progress(items, labels)) == [("t1", 3, 1, 1, 2), ("t2", 3, 1, 1, 1), ("t3", 3, 0, 1, 0)]
    assert [r.row_id for r in op.queue(items, labels, "t2", "B").orderBy("row_id").collect()] == ["a", "b", "c"]
    assert [r.row_id for r in op.queue(items, labels, "t1", "B").orderBy("row_id").collect()] == ["b", "c"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pair_counts_equal_brute_force(spark, seed):
    r = random.Random(seed)
    data = [(r.choice("pqr"), r.choice("xyz"), r.choice(["human", "human", "llm"]), r.choice("ABCD"), 1.0) for _ in range(120)]
    human = [d for d in data if d[2] == "human"]
    for key in "pqr":
        mine = [d for d in human if d[0] == key]
        pairs = [(a, b) for a, b in itertools.product(mine, mine) if a[3] < b[3]]
        got = op.pair_counts(frame(spark, data), ["row_id"]).filter(F.col("row_id") == key).head()
        assert (got.n_pairs, got.n_agree) == (len(pairs), sum(a[1] == b[1] for a, b in pairs))


def test_pair_counts_of_a_huge_group(spark):
    """A million labels on one row: the pairs, half a trillion, are only counted."""
    big = spark.range(1_000_000).select(
        F.lit("r").alias("row_id"), F.lit("human").alias("source"), (F.col("id") % 2).cast("string").alias("label"), (F.col("id") % 1000).cast("string").alias("annotator")
    )
    got = op.pair_counts(big, ["row_id"]).head()
    assert got.n_pairs == (1_000_000**2 - 1000 * 1000**2) // 2
    assert got.n_agree == 2 * ((500_000**2 - 500 * 1000**2) // 2)


def test_agreement_without_pairs(spark):
    r = op.agreement(frame(spark, [("a", "x", "human", "A", 1.0), ("a", "x", "llm", "m", 0.5)])).head()
    assert (r.human_human_agreement, r.n_double_labelled, r.human_llm_agreement) == (None, 0, 1.0)


def test_queue_order(spark):
    rows_ = spark.createDataFrame([(x, f"title {x}") for x in "abcde"], "row_id string, title string")
    labels = frame(spark, [
        ("a", "x", "human", "me", 1.0), ("b", "x", "human", "other", 1.0), ("c", "x", "llm", "m", 0.9), ("d", "x", "llm", "m", 0.55),
    ])
    got = op.queue(rows_, labels, "t", "me").collect()
    # mine is gone; no model label counts as least certain; rows with human labels come last
    assert [r.row_id for r in got] == ["e", "d", "c", "b"]
    assert got[0].llm_label is None and got[1].llm_conf == 0.55 and got[3].n_human_labels == 1
    assert op.queue(rows_, labels, "t", "me", limit=2).count() == 2


def test_validate(spark, rows):
    tasks = spark.createDataFrame([("t", '["x","y"]')], "task_id string, label_space string")
    labels = frame(spark, [("a", "x", "human", "A", 1.0), ("a", "q", "human", "A", 1.0)]).unionByName(
        frame(spark, [("a", "x", "human", "A", 1.0)]).withColumn("task_id", F.lit("unknown")).withColumn("label_id", F.lit("9"))
    )
    assert rows(op.validate(labels, tasks), "label_id", "accepted") == [("0", True), ("1", False), ("9", False)]


def test_progress(spark):
    labels = frame(spark, [("a", "x", "human", "A", 1.0), ("a", "x", "human", "B", 1.0), ("b", "x", "llm", "m", 1.0)])
    r = op.progress(spark.range(7), labels).head()
    assert (r.n_rows, r.n_human_rows, r.n_llm_rows, r.n_annotators) == (7, 1, 1, 2)


def test_select_batch_takes_one_of_each_title(spark):
    c = spark.createDataFrame(
        [
            ("1", 0.5, None, None, "en", "peer_reviewed", "Same  title!"), ("2", 0.49, None, None, "en", "peer_reviewed", "same title"),
            ("3", 0.99, None, None, "fr", "news", "other"), ("4", 0.6, None, False, "en", "peer_reviewed", "third"), ("5", 0.6, None, True, "en", "peer_reviewed", "fourth"),
        ],
        "row_id string, p_relevant double, llm_conf double, llm_include boolean, language string, source_type string, title string",
    )
    got = [r.row_id for r in op.select_batch(c, 10, F.lit(False)).collect()]
    assert got == ["4", "1", "5", "3"]
    assert op.select_batch(c, 2, F.lit(False)).count() == 2
