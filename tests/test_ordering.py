"""The binned order equals a plain window, whatever the score distribution."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftmap.plans.ordering import global_order


def plain(df):
    w = Window.orderBy(F.desc_nulls_last("p"), F.md5("id"), "id")
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "id", F.rank().over(Window.orderBy(F.desc_nulls_last("p"))).cast("bigint").alias("rank_no"), F.row_number().over(w).cast("bigint").alias("row_no"),
        F.coalesce(F.round(F.sum("v").over(up), 6), F.lit(0.0)).alias("run"),
    )


def binned(df, depth):
    o = global_order(df, "p", "id", sums=("v",), depth=depth)
    return o.select("id", "rank_no", "row_no", F.round("v_running", 6).alias("run"))


CASES = {
    "distinct": lambda r, i: r.random(),
    "one score for all": lambda r, i: 0.5,
    "a third tied at the top": lambda r, i: 1.0 if i % 3 == 0 else r.random() / 2,
    "a third tied in the middle": lambda r, i: 0.4 if i % 3 == 0 else r.random(),
    "piled up near zero": lambda r, i: r.random() ** 40,
    "few values": lambda r, i: r.choice([0.1, 0.2, 0.3]),
    "a third missing": lambda r, i: None if i % 3 == 0 else r.random(),
    "all missing": lambda r, i: None,
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_equals_plain_window(spark, rows, case, depth):
    r = random.Random(11)
    df = spark.createDataFrame([(f"d{i}", CASES[case](r, i), r.random()) for i in range(400)], "id string, p double, v double")
    assert rows(binned(df, depth)) == rows(plain(df))


def test_totals_and_empty_input(spark):
    df = spark.createDataFrame([("a", 0.9, 2.0), ("b", 0.1, 3.0)], "id string, p double, v double")
    got = global_order(df, "p", "id", sums=("v",)).orderBy("row_no").collect()
    assert [(r.id, r.v_running, r.v_total, r.rows_total) for r in got] == [("a", 2.0, 5.0, 2), ("b", 5.0, 5.0, 2)]
    assert global_order(df.limit(0), "p", "id", sums=("v",)).count() == 0


def test_tied_rows_are_spread_over_sub_bins(spark):
    """A score shared by all rows must not end up in one window group."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(0.5).alias("p"))
    plan = global_order(df, "p", "id", depth=3)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text  # the input is read and shuffled once for all passes
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
