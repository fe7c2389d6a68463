import datetime as dt

import pytest

from siftmap.operators import living as op


def series(spark, data):
    return spark.createDataFrame([(c, dt.date(y, 1, 1), n) for c, y, n in data], "cluster_id bigint, yr date, n_docs bigint")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, f"l{i}", "s") for i in (1, 2, 3, 4)], "cluster_id bigint, label string, sector string")


def test_the_cutoff_year_differs_between_the_variants(spark, labels):
    counts = series(spark, [(1, 2020, 10), (1, 2021, 10), (1, 2022, 5)])
    full = {r.cluster_id: r for r in op.alerts(labels, counts, op.trend(counts)).collect()}
    assert (full[1].n_before_ar6, full[1].n_since_ar6, full[1].growth_since_ar6) == (20, 5, 0.25) and full[1].update_status == "watch"
    plain = op.alerts_plain(counts, labels).head()
    assert (plain.n_before_ar6, plain.n_since_ar6, plain.growth_since_ar6) == (10, 15, 0.5) and plain.update_status == "update_now"


def test_missing_growth_is_stable(spark, labels):
    counts = series(spark, [(1, 2010, 3), (2, 2023, 3)])
    got = {r.cluster_id: (r.growth_since_ar6, r.update_status) for r in op.alerts(labels, counts, op.trend(counts)).collect()}
    assert got == {1: (None, "stable"), 2: (None, "stable"), 3: (None, "stable"), 4: (None, "stable")}


def test_too_few_years(spark, labels):
    assert op.alerts_plain(series(spark, [(1, 2010, 3), (1, 2023, 30)]), labels).head().update_status == "insufficient_data"


def test_a_straight_line_is_continued_without_spread(spark):
    counts = series(spark, [(1, 2010 + i, 5 + 2 * i) for i in range(6)])
    got = op.trend(counts).orderBy("forecast_timestamp").collect()
    assert [round(r.forecast_value, 6) for r in got] == [17.0, 19.0, 21.0]
    assert all(abs(r.prediction_interval_upper_bound - r.prediction_interval_lower_bound) < 1e-3 for r in got)


def test_interval_contains_the_mean_and_short_series_have_none(spark):
    counts = series(spark, [(1, 2010, 5), (1, 2011, 9), (1, 2012, 4), (1, 2014, 12), (2, 2010, 3), (2, 2011, 4), (3, 2010, 1)])
    for r in op.trend(counts).collect():
        if r.cluster_id == 1:
            assert r.prediction_interval_lower_bound < r.forecast_value < r.prediction_interval_upper_bound
        else:
            assert r.prediction_interval_lower_bound is None
    for r in op.autoregressive(counts).collect():
        assert r.lo <= r.forecast <= r.hi


def test_drivers_recover_a_plane(spark):
    past = spark.createDataFrame([(1, 2000 + i, float(3 + 2 * i + 5 * (i * i % 7)), float(i * i % 7)) for i in range(9)], "cluster_id bigint, year int, n_docs double, x double")
    ahead = spark.createDataFrame([(1, 2009, 4.0)], "cluster_id bigint, year int, x double")
    assert round(op.trend_with_drivers(past, ahead, ["x"]).head().forecast, 6) == 3 + 18 + 20


@pytest.mark.parametrize(
    "text,year",
    [
        ("Publication year: 2014.", 2014), ("PUBLISHED in May of 1999", 1999), ("Year of publication 2031", None),
        ("published 1949", None), ("seen in 2014", None), ("published by a very long list of names that never ends 2014", None),
    ],
)
def test_only_labelled_years_count(spark, text, year):
    got = op.publication_years(spark.createDataFrame([("d", text)], "doc_id string, abstract string")).collect()
    assert [r.publication_year for r in got] == ([year] if year else [])


def test_distinct_documents(spark):
    c = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, cluster_id bigint")
    y = spark.createDataFrame([("a", 2010), ("a", 2010), ("b", 2010)], "doc_id string, publication_year int")
    assert op.yearly_distinct(c, y).head().n_docs == 2
