"""Automatic ARIMA for many series at once, by Spark.

`fit` turns rows (series, time, value) into one model row per series: values are averaged per period before the shuffle, each series is then
one group of one row per period, and all series are fitted in one distributed step. The models are a table like any other; `forecast`,
`residual_report` and `backtest` read it.

Orders are searched per series: the number of differences by repeated level-stationarity tests, then autoregressive and moving-average orders
and a constant, stepwise, by the corrected information criterion of the exact Gaussian likelihood, which a Kalman filter gives. Coefficients are searched
through partial autocorrelations, so every model is stationary and invertible.

Defined cases: rows without a time or a value are left out; periods between the first and the last without a value are interpolated; a series of
fewer than four points has its mean as forecast, without an interval if there is only one point; a constant series is continued with an interval of
no width. Several values of a period count with their mean. With drivers, values are first regressed on them and the rest gets the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmap.functions.vectors import interval_z

#: Largest orders tried, and largest sum of both.
MOST_P, MOST_Q, MOST_SUM = 3, 3, 4
MOST_D = 2
#: Level stationarity is doubted above this value of the test (five per cent).
DOUBT = 0.463
#: Partial autocorrelations stay below tanh of this, so that no chosen model is close to having a unit root.
FURTHEST = 2.0
#: Periods per year, and how a date becomes a number of periods.
FREQUENCIES = ("YEARLY", "MONTHLY", "DAILY")

FITTED = (
    "p int, d int, q int, constant double, ar array<double>, ma array<double>, variance double, log_likelihood double, aic double, aicc double, n_points int, "
    "first_period int, last_period int, state array<double>, tail array<double>, intercept double, effects array<double>"
)


@dataclass(frozen=True)
class Series:
    """Columns of a table of series: time, value, the series' key (None: the table is one series), and drivers."""

    time: str
    value: str
    key: str | None = None
    drivers: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return [self.time, self.value, *([self.key] if self.key else []), *self.drivers]


def period(time: Column, frequency: str) -> Column:
    if frequency == "YEARLY":
        return F.year(time)
    if frequency == "MONTHLY":
        return F.year(time) * 12 + F.month(time) - 1
    if frequency == "DAILY":
        return F.unix_date(time.cast("date"))
    raise ValueError(f"frequency is one of {', '.join(FREQUENCIES)}")


def date_of(number: Column, frequency: str) -> Column:
    if frequency == "YEARLY":
        return F.make_date(number, F.lit(1), F.lit(1))
    if frequency == "MONTHLY":
        return F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_from_unix_date(number)


def _coefficients(u: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients of a stationary process from unbounded numbers, by way of partial autocorrelations."""
    out = np.zeros(0)
    for r in np.tanh(u):
        out = np.append(out - r * out[::-1], r)
    return out


def _start(transition: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Stationary covariance of the state."""
    r = len(load)
    return np.linalg.solve(np.eye(r * r) - np.kron(transition, transition), np.outer(load, load).ravel()).reshape(r, r)


def _filter(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Minus log likelihood with the variance concentrated out, that variance, and the predicted next state."""
    r = max(len(ar), len(ma) + 1)
    transition = np.zeros((r, r))
    transition[:len(ar), 0] = ar
    transition[:-1, 1:] += np.eye(r - 1)
    load = np.zeros(r)
    load[0], load[1:len(ma) + 1] = 1.0, ma
    noise = np.outer(load, load)
    p, state = _start(transition, load), np.zeros(r)
    squares = logs = 0.0
    k = 0
    for k, x in enumerate(w):
        spread = p[0, 0]
        if spread - 1 < 1e-8 and k >= r:
            break
        error = x - state[0]
        squares += error * error / spread
        logs += math.log(spread)
        gain = p[:, 0] / spread
        state = transition @ (state + gain * error)
        p = transition @ (p - np.outer(gain, p[0])) @ transition.T + noise
    else:
        k = len(w)
    # from here on shocks are known exactly, and the filter is a plain recursion
    s, own, load = state.tolist(), transition[:, 0].tolist(), load.tolist()
    for x in w[k:].tolist():
        error = x - s[0]
        squares += error * error
        s = [own[i] * x + (s[i + 1] + load[i + 1] * error if i + 1 < r else 0.0) for i in range(r)]
    state = np.array(s)
    variance = max(squares / len(w), 1e-300)
    return 0.5 * (len(w) * (math.log(2 * math.pi * variance) + 1) + logs), variance, state


def _minimum(f, start: np.ndarray, near: float = 2e-3, scale: float = 0.3, rounds: int = 200) -> np.ndarray:
    """A simplex search from `start`, until its values are as `near` each other."""
    n = len(start)
    points = np.vstack([start, start + scale * np.eye(n)])
    values = np.array([f(x) for x in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < near:
            break
        middle = points[:-1].mean(axis=0)
        away = middle + (middle - points[-1])
        v = f(away)
        if v < values[0]:
            further = middle + 2 * (middle - points[-1])
            u = f(further)
            points[-1], values[-1] = (further, u) if u < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            inner = middle + 0.5 * ((away if v < values[-1] else points[-1]) - middle)
            u = f(inner)
            if u < min(v, values[-1]):
                points[-1], values[-1] = inner, u
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(x) for x in points[1:]]
    return points[values.argmin()]


def _doubtful(w: np.ndarray) -> bool:
    """Whether a level-stationarity test speaks against the series."""
    n = len(w)
    e = w - w.mean()
    lags = max(1, int(0.5 * math.sqrt(n)))
    long_run = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return long_run > 1e-12 * max(1.0, float(w @ w)) and (np.cumsum(e) ** 2).sum() / (n * long_run) > DOUBT


def fit_one(y: np.ndarray, order: tuple[int, int, int] | None = None) -> dict:
    """The model of one series of evenly spaced values; `order` fixes p, d, q, else they are searched."""
    d = 0
    if order is not None:
        d = order[1]
    else:
        while d < MOST_D and len(y) - d >= 8 and _doubtful(np.diff(y, d)):
            d += 1
    w = np.diff(y, d)
    n = len(w)
    tail = [float(np.diff(y, k)[-1]) for k in range(d)]
    base = {"d": d, "tail": tail, "n_points": len(y)}

    def result(p, q, constant, ar, ma, cost, variance, state):
        k = p + q + (constant is not None) + 1
        aicc = 2 * cost + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf)
        return base | {"p": p, "q": q, "constant": float(constant or 0.0), "ar": [float(v) for v in ar], "ma": [float(v) for v in ma], "variance": float(variance),
                       "log_likelihood": float(-cost), "aic": float(2 * cost + 2 * k), "aicc": float(aicc), "state": [float(v) for v in state]}

    spread = float(w.std()) if n else 0.0
    if n < 4 - d or n < 2 or spread < 1e-9 * max(1.0, float(np.abs(y).max())):
        # too short, or all alike: the mean goes on
        mean = float(w.mean()) if n else 0.0
        variance = float(w.var(ddof=1)) if n > 1 else math.nan
        variance = 0.0 if n > 1 and spread < 1e-9 * max(1.0, float(np.abs(y).max())) else variance
        return base | {"p": 0, "q": 0, "constant": mean, "ar": [], "ma": [], "variance": variance, "log_likelihood": math.nan, "aic": math.nan, "aicc": math.nan, "state": [0.0]}
    tried: dict[tuple[int, int, bool], dict] = {}

    def attempt(p: int, q: int, level: bool, fine: bool = False) -> float:
        """The criterion of one model, fitted once, and once more finely if it is chosen."""
        if not (0 <= p <= MOST_P and 0 <= q <= MOST_Q) or (order is None and (p + q > MOST_SUM or n - (p + q + level + 1) - 1 <= 0)) or (level and d > 1):
            return math.inf
        if fine or (p, q, level) not in tried:

            def split(u):
                return (u[-1] * spread if level else 0.0), _coefficients(u[:p]), -_coefficients(u[p:p + q])

            def cost(u):
                if np.abs(u[:p + q]).max(initial=0.0) > FURTHEST:
                    return 1e12
                mean, ar, ma = split(u)
                return _filter(w - mean, ar, ma)[0]

            start = np.zeros(p + q + level)
            if level:
                start[-1] = w.mean() / spread
            u = start
            if len(start):
                u = _minimum(cost, start)
                if fine:
                    u = _minimum(cost, u, 1e-9, 0.05, 600)
            mean, ar, ma = split(u)
            tried[p, q, level] = result(p, q, mean if level else None, ar, ma, *_filter(w - mean, ar, ma))
        return tried[p, q, level]["aicc"]

    if order is not None:
        here = min(((order[0], order[2], level) for level in (True, False) if d < 2 or not level), key=lambda m: attempt(*m))
        attempt(*here, fine=True)
        return tried[here]
    # from four usual models on to better neighbours, until there is none
    here = min(((p, q, d < 2) for p, q in ((0, 0), (1, 0), (0, 1), (2, 2))), key=lambda m: attempt(*m))
    while True:
        p, q, level = here
        near = [(p + i, q + j, level) for i in (-1, 0, 1) for j in (-1, 0, 1)] + [(p, q, not level)]
        better = min(near, key=lambda m: attempt(*m))
        if attempt(*better) >= attempt(*here) - 1e-6:
            break
        here = better
    if here in tried:
        attempt(*here, fine=True)
        return tried[here]
    # so few points that no criterion is defined
    return result(0, 0, float(w.mean()), np.zeros(0), np.zeros(0), *_filter(w - w.mean(), np.zeros(0), np.zeros(0)))


def ahead(model: dict, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the next values."""
    ar, ma, d = np.asarray(model["ar"], float), np.asarray(model["ma"], float), int(model["d"])
    state = np.asarray(model["state"], float)
    mean = np.empty(horizon)
    full = np.zeros(len(state))
    full[:len(ar)] = ar
    for h in range(horizon):
        mean[h] = state[0] + model["constant"]
        state = full * state[0] + np.append(state[1:], 0.0)
    for last in reversed(model["tail"]):
        mean = last + np.cumsum(mean)
    # weights of past shocks in the undifferenced series
    grown = np.append(1.0, -ar)
    for _ in range(d):
        grown = np.convolve(grown, [1.0, -1.0])
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = (1.0 if j == 0 else ma[j - 1] if j <= len(ma) else 0.0) - sum(grown[i] * psi[j - i] for i in range(1, min(j, len(grown) - 1) + 1))
    return mean, np.sqrt(model["variance"] * np.cumsum(psi * psi))


def _even(pdf: pd.DataFrame, drivers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods from first to last, values and drivers, with gaps interpolated."""
    pdf = pdf.sort_values("period")
    at = pdf["period"].to_numpy()
    every = np.arange(at[0], at[-1] + 1)
    x = np.column_stack([np.ones(len(every)), *[np.interp(every, at, pdf[c].to_numpy(float)) for c in drivers]])
    return every, np.interp(every, at, pdf["value"].to_numpy(float)), x


def _group(pdf: pd.DataFrame, drivers: list[str], order) -> dict:
    every, y, x = _even(pdf, drivers)
    beta = np.zeros(1 + len(drivers))
    if drivers:
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        y = y - x @ beta
    return fit_one(y, order) | {"first_period": int(every[0]), "last_period": int(every[-1]), "intercept": float(beta[0]), "effects": [float(b) for b in beta[1:]]}


def _rows(data: DataFrame, series: Series, frequency: str) -> DataFrame:
    """series, period, value and drivers, one row per series and period; combined before the shuffle."""
    key = F.col(series.key) if series.key else F.lit(0).cast("bigint")
    drivers = [F.avg(F.col(c).cast("double")).alias(f"driver_{k}") for k, c in enumerate(series.drivers)]
    rows = data.select(key.alias("series"), period(F.col(series.time), frequency).alias("period"), F.col(series.value).cast("double").alias("value"), *series.drivers)
    return rows.where("period IS NOT NULL AND value IS NOT NULL").groupBy("series", "period").agg(F.avg("value").alias("value"), *drivers)


def fit(data: DataFrame, series: Series, frequency: str = "YEARLY", order: tuple[int, int, int] | None = None, holdout: int = 0) -> DataFrame:
    """One model row per series: `series` and the columns of FITTED. `holdout` periods at the end of each series are left out."""
    rows = _rows(data, series, frequency)
    kind = dict(rows.dtypes)["series"]
    drivers = [f"driver_{k}" for k in range(len(series.drivers))]
    names = ["series", *(c.split()[0] for c in FITTED.split(", "))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if holdout:
            pdf = pdf[pdf["period"] <= pdf["period"].max() - holdout]
        if pdf.empty:
            return pd.DataFrame({c: [] for c in names})
        return pd.DataFrame([{"series": pdf["series"].iloc[0]} | _group(pdf, drivers, order)])[names]

    return rows.groupBy("series").applyInPandas(run, f"series {kind}, {FITTED}")


def forecast(models: DataFrame, horizon: int = 3, confidence: float = 0.8, frequency: str = "YEARLY", future: DataFrame | None = None, series: Series | None = None) -> DataFrame:
    """series, forecast_timestamp, forecast_value, prediction_interval_lower_bound and _upper_bound.

    Models with drivers need `future`, a table of the same columns for the periods ahead; a period that it lacks has no forecast.
    """
    z = interval_z(confidence)
    kind = dict(models.dtypes)["series"]

    def run(batches):
        for pdf in batches:
            out = {"series": [], "period": [], "mean": [], "half": []}
            for m in pdf.to_dict("records"):
                mean, deviation = ahead(m, horizon)
                out["series"] += [m["series"]] * horizon
                out["period"] += [int(m["last_period"]) + h for h in range(1, horizon + 1)]
                out["mean"] += (mean + m["intercept"]).tolist()
                out["half"] += (z * deviation).tolist()
            yield pd.DataFrame(out)

    out = models.mapInPandas(run, f"series {kind}, period int, mean double, half double")
    mean = F.col("mean")
    if series is not None and series.drivers:
        known = _rows(future.withColumn(series.value, F.lit(0.0)), series, frequency).drop("value")
        effects = models.select("series", "effects").toDF("of", "effects")
        driven = [f"driver_{k}" for k in range(len(series.drivers))]
        same = F.col("a.series").eqNullSafe(F.col("b.series")) & (F.col("a.period") == F.col("b.period"))
        out = out.join(effects, F.col("series").eqNullSafe(F.col("of"))).drop("of").alias("a").join(known.alias("b"), same, "left").select("a.*", *driven)
        for k in range(len(series.drivers)):
            mean = mean + F.col("effects")[k] * F.col(f"driver_{k}")
    half = F.when(~F.isnan("half"), F.col("half"))
    return out.select(
        "series", date_of(F.col("period"), frequency).alias("forecast_timestamp"), mean.alias("forecast_value"),
        (mean - half).alias("prediction_interval_lower_bound"), (mean + half).alias("prediction_interval_upper_bound"))


def residual_report(models: DataFrame) -> DataFrame:
    """What the search chose per series: orders, whether there is a constant, likelihood, criterion and variance."""
    number = {c: F.when(~F.isnan(c), F.col(c)) for c in ("log_likelihood", "aic", "variance")}
    return models.select(
        "series", F.col("p").alias("non_seasonal_p"), F.col("d").alias("non_seasonal_d"), F.col("q").alias("non_seasonal_q"),
        (F.col("constant") != 0).alias("has_drift"), "n_points", *[v.alias(c) for c, v in number.items()])


def backtest(data: DataFrame, series: Series, horizon: int = 3, confidence: float = 0.8, frequency: str = "YEARLY", order: tuple[int, int, int] | None = None) -> DataFrame:
    """One row: the last `horizon` periods of every series against forecasts of models that have not seen them.

    mean_absolute_error, mean_absolute_percentage_error (of values other than 0), coverage of the intervals, and how many values were compared.
    """
    models = fit(data, series, frequency, order, holdout=horizon)
    guess = forecast(models, horizon, confidence, frequency, data if series.drivers else None, series if series.drivers else None)
    truth = _rows(data, series, frequency).select(F.col("series").alias("of"), date_of(F.col("period"), frequency).alias("at"), "value")
    both = truth.join(guess, F.col("of").eqNullSafe(F.col("series")) & (F.col("at") == F.col("forecast_timestamp")))
    off = F.abs(F.col("value") - F.col("forecast_value"))
    inside = F.col("value").between(F.col("prediction_interval_lower_bound"), F.col("prediction_interval_upper_bound"))
    return both.agg(
        F.count("forecast_value").alias("n_compared"), F.avg(off).alias("mean_absolute_error"),
        F.avg(F.when(F.col("value") != 0, off / F.abs("value"))).alias("mean_absolute_percentage_error"), F.avg(inside.cast("double")).alias("coverage"))
