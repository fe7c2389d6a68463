import collections
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmap.operators import arima


def simulated(rng, n, ar=(), ma=(), d=0, level=0.0):
    e = rng.normal(size=n + 60)
    w = np.zeros(n + 60)
    for t in range(3, n + 60):
        w[t] = e[t] + sum(a * w[t - k] for k, a in enumerate(ar, 1)) + sum(m * e[t - k] for k, m in enumerate(ma, 1))
    w = w[60:] + level
    for _ in range(d):
        w = np.cumsum(w)
    return w


def table(spark, named, first=1800):
    rows = [(k, dt.date(first + t, 1, 1), float(v)) for k, y in named.items() for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "cluster_id string, yr date, n_docs double").repartition(4)


SERIES = arima.Series("yr", "n_docs", "cluster_id")


@pytest.mark.parametrize("ar,ma", [((0.7,), ()), ((), (0.6,)), ((0.5, -0.3), (0.4,)), ((), ())])
def test_likelihood_equals_that_of_the_joint_normal(ar, ma):
    rng = np.random.default_rng(1)
    w = rng.normal(size=12)
    psi = [1.0]
    for j in range(1, 400):
        psi.append((ma[j - 1] if j <= len(ma) else 0.0) + sum(a * psi[j - k] for k, a in enumerate(ar, 1) if j >= k))
    psi = np.array(psi)
    gamma = [psi[: len(psi) - k] @ psi[k:] for k in range(12)]
    cov = np.array([[gamma[abs(i - j)] for j in range(12)] for i in range(12)])
    s2 = w @ np.linalg.solve(cov, w) / 12
    want = 0.5 * (12 * math.log(2 * math.pi * s2) + np.linalg.slogdet(cov)[1] + 12)
    cost, variance, _ = arima._filter(w, np.array(ar), np.array(ma))
    assert cost == pytest.approx(want, rel=1e-8) and variance == pytest.approx(s2, rel=1e-8)


def test_orders_are_recovered(spark):
    rng = np.random.default_rng(7)
    kinds = {"1,0,0": dict(ar=(0.7,), level=5.0), "0,1,1": dict(ma=(0.7,), d=1), "0,0,0": dict(level=3.0), "2,0,0": dict(ar=(0.5, -0.6))}
    named = {f"{kind}/{k}": simulated(rng, 130, **how) for kind, how in kinds.items() for k in range(4)}
    found = collections.defaultdict(collections.Counter)
    for r in arima.fit(table(spark, named), SERIES).collect():
        found[r.series.split("/")[0]][f"{r.p},{r.d},{r.q}"] += 1
    for kind in kinds:
        assert found[kind][kind] >= 2, dict(found[kind])


def test_coefficients_and_forecast_of_a_first_order_series():
    y = simulated(np.random.default_rng(2), 2000, ar=(0.8,), level=0.0) + 10
    m = arima.fit_one(y, (1, 0, 0))
    assert m["ar"][0] == pytest.approx(0.8, abs=0.05) and m["variance"] == pytest.approx(1.0, abs=0.1)
    mean, deviation = arima.ahead(m, 4)
    phi, mu = m["ar"][0], m["constant"]
    assert mean == pytest.approx([mu + phi**h * (y[-1] - mu) for h in range(1, 5)], rel=1e-6)
    assert deviation == pytest.approx([math.sqrt(m["variance"] * sum(phi ** (2 * j) for j in range(h))) for h in range(1, 5)], rel=1e-9)


def test_a_random_walk_with_drift_goes_on():
    y = np.cumsum(np.random.default_rng(3).normal(size=400) * 0.1 + 1.0)
    m = arima.fit_one(y, (0, 1, 0))
    mean, deviation = arima.ahead(m, 3)
    assert mean == pytest.approx(y[-1] + m["constant"] * np.arange(1, 4)) and deviation == pytest.approx(np.sqrt(m["variance"] * np.arange(1, 4)))


def test_intervals_cover_about_what_they_say(spark):
    rng = np.random.default_rng(5)
    named = {f"s{k}": simulated(rng, 60, **(dict(ar=(0.6,)) if k % 2 else dict(ma=(0.5,), d=1))) for k in range(32)}
    r = arima.backtest(table(spark, named), SERIES, horizon=4, order=None).first()
    assert r.n_compared == 128 and 0.66 <= r.coverage <= 0.92


def test_short_constant_gapped_and_repeated_series(spark):
    rows = [("one", 2000, 7.0), ("three", 2000, 1.0), ("three", 2001, 2.0), ("three", 2002, 3.0), (None, 2001, 4.0), (None, 2002, 6.0)]
    rows += [("flat", 2000 + k, 5.0) for k in range(9)]
    rows += [("gap", y, float(2 * y - 4000)) for y in (2000, 2001, 2004, 2009, 2010)] + [("gap", 2001, 2.0), ("gap", 2005, None), ("gap", None, 3.0)]
    data = spark.createDataFrame([(k, None if y is None else dt.date(y, 5, 6), v) for k, y, v in rows], "cluster_id string, yr date, n_docs double")
    models = arima.fit(data, SERIES)
    assert {r.series: r.n_points for r in models.collect()} == {"one": 1, "three": 3, None: 2, "flat": 9, "gap": 11}
    got = {(r.series, r.forecast_timestamp.year): tuple(r)[2:] for r in arima.forecast(models, 2).collect()}
    assert got["one", 2001] == (7.0, None, None) and got["flat", 2009] == (5.0, 5.0, 5.0) and got["three", 2003][0] == 2.0 and got["three", 2003][1] < 2.0
    assert got["gap", 2011][0] == pytest.approx(22.0) and got["gap", 2012][0] == pytest.approx(24.0)
    assert (None, 2003) in got and len(got) == 10
    assert arima.fit(data.limit(0), SERIES).isEmpty()


def test_one_series_without_a_key_and_other_frequencies(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 7)) for k in range(60)]
    data = spark.createDataFrame(days, "day date, n double")
    out = arima.forecast(arima.fit(data, arima.Series("day", "n"), "DAILY", (1, 0, 1)), 2, frequency="DAILY").orderBy("forecast_timestamp").collect()
    assert [r.forecast_timestamp for r in out] == [dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
    months = spark.createDataFrame([(dt.date(2020 + k // 12, k % 12 + 1, 9), float(k)) for k in range(23)], "day date, n double")
    out = arima.forecast(arima.fit(months, arima.Series("day", "n"), "MONTHLY"), 2, frequency="MONTHLY").orderBy("forecast_timestamp").collect()
    assert [(r.forecast_timestamp, round(r.forecast_value, 3)) for r in out] == [(dt.date(2021, 12, 1), 23.0), (dt.date(2022, 1, 1), 24.0)]
    with pytest.raises(ValueError):
        arima.fit(data, arima.Series("day", "n"), "HOURLY")


def test_drivers_explain_and_missing_ones_give_no_forecast(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=43) * 4
    y = 2 + 3 * x[:40] + rng.normal(size=40) * 0.05
    rows = [("a", dt.date(1980 + k, 1, 1), float(y[k]) if k < 40 else 0.0, float(x[k])) for k in range(42)]
    data = spark.createDataFrame(rows, "cluster_id string, yr date, n_docs double, x double")
    series = arima.Series("yr", "n_docs", "cluster_id", ("x",))
    past, future = data.where(F.year("yr") < 2020), data.where(F.year("yr") >= 2020).drop("n_docs")
    out = arima.forecast(arima.fit(past, series), 3, future=future, series=series).orderBy("forecast_timestamp").collect()
    assert [r.forecast_value for r in out][:2] == pytest.approx(2 + 3 * x[40:42], abs=0.3) and out[2].forecast_value is None
