"""Publication growth per cluster: yearly counts, alerts and a trend forecast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmap.functions.vectors import interval_z


def yearly(clusters: DataFrame, years: DataFrame, first: int = 2005, last: int | None = None, year: str = "year") -> DataFrame:
    """Documents per cluster and year, from `first` to `last`, or to the newest year there is."""
    within = F.col("_y") >= first if last is None else F.col("_y").between(first, last)
    return (
        clusters.select("doc_id", "cluster_id").join(years.select("doc_id", F.col(year).alias("_y")), "doc_id")
        .filter(F.col("_y").isNotNull() & within)
        .groupBy("cluster_id", F.make_date("_y", F.lit(1), F.lit(1)).alias("yr"))
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )


def yearly_distinct(clusters: DataFrame, years: DataFrame, year: str = "publication_year") -> DataFrame:
    """Distinct documents per cluster and year, for inputs with several rows per document."""
    return (
        clusters.select("doc_id", "cluster_id").join(years.select("doc_id", F.col(year).alias("_y")), "doc_id")
        .groupBy("cluster_id", F.make_date("_y", F.lit(1), F.lit(1)).alias("yr"))
        .agg(F.countDistinct("doc_id").alias("n_docs"))
    )


# Fixed value: a publication year counts only where the text labels it as one.
YEAR_LABEL = r"(?:publication year|year of publication|published)[^0-9]{0,30}(19[5-9][0-9]|20[0-2][0-9])"


def publication_years(docs: DataFrame, text: str = "abstract", pattern: str = YEAR_LABEL) -> DataFrame:
    found = F.regexp_extract(F.lower(text), pattern, 1)
    return docs.select("doc_id", found.alias("_y")).filter(F.col("_y") != "").select(
        "doc_id", F.col("_y").try_cast("bigint").alias("publication_year"),
        F.lit("explicit_publication_label").alias("extraction_method"),
    )


def status(growth: Column) -> Column:
    return F.when(growth >= 0.5, "update_now").when(growth >= 0.25, "watch").otherwise("stable")


def alerts(labels: DataFrame, counts: DataFrame, forecast: DataFrame, cutoff: int = 2021) -> DataFrame:
    """Every labelled cluster; the cut-off year itself counts as before. Missing growth is stable."""
    y = F.year("yr")
    sums = counts.groupBy("cluster_id").agg(
        F.sum(F.when(y <= cutoff, F.col("n_docs"))).alias("n_before_ar6"),
        F.sum(F.when(y > cutoff, F.col("n_docs"))).alias("n_since_ar6"),
    )
    ahead = forecast.groupBy("cluster_id").agg(F.sum("forecast_value").alias("n_forecast_3y"))
    growth = F.try_divide("n_since_ar6", "n_before_ar6")
    return (
        labels.select("cluster_id", "label", "sector").join(sums, "cluster_id", "left").join(ahead, "cluster_id", "left")
        .select("cluster_id", "label", "sector", "n_before_ar6", "n_since_ar6", "n_forecast_3y",
                growth.alias("growth_since_ar6"), status(growth).alias("update_status"))
    )


def alerts_plain(counts: DataFrame, labels: DataFrame, cutoff: int = 2021) -> DataFrame:
    """The variant without a forecast: the cut-off year counts as since, growth is ratio - 1, and
    fewer than three observed years give no verdict."""
    y = F.year("yr")
    sums = counts.groupBy("cluster_id").agg(
        F.countDistinct(y).alias("observed_years"),
        F.sum(F.when(y < cutoff, F.col("n_docs")).otherwise(0)).alias("n_before_ar6"),
        F.sum(F.when(y >= cutoff, F.col("n_docs")).otherwise(0)).alias("n_since_ar6"),
    )
    growth = F.try_divide("n_since_ar6", F.nullif(F.col("n_before_ar6"), F.lit(0))) - 1
    return sums.join(labels.select("cluster_id", "label", "sector"), "cluster_id", "left").select(
        "cluster_id", "label", "sector", "n_before_ar6", "n_since_ar6",
        F.lit(None).cast("double").alias("n_forecast_3y"),
        growth.alias("growth_since_ar6"),
        F.when(F.col("observed_years") < 3, "insufficient_data").otherwise(status(growth)).alias("update_status"),
    )


def trend(counts: DataFrame, horizon: int = 3, confidence: float = 0.8) -> DataFrame:
    """Linear trend per cluster with a prediction interval, from aggregates alone.

    A substitute for automatic ARIMA. Series with fewer than three years have no interval.
    """
    x, v = F.year("yr").cast("double"), F.col("n_docs").cast("double")
    fit = counts.groupBy("cluster_id").agg(
        F.regr_slope(v, x).alias("b"), F.regr_intercept(v, x).alias("a"), F.regr_avgx(v, x).alias("mx"),
        F.regr_sxx(v, x).alias("sxx"), F.regr_syy(v, x).alias("syy"), F.regr_sxy(v, x).alias("sxy"),
        F.regr_count(v, x).alias("n"), F.max(x).alias("last"),
    )
    steps = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("last") + F.col("h")
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    sigma2 = F.when(F.col("n") > 2, rest / (F.col("n") - 2))
    half = interval_z(confidence) * F.sqrt(sigma2 * (1 + 1 / F.col("n") + F.try_divide((at - F.col("mx")) * (at - F.col("mx")), F.col("sxx"))))
    mean = F.col("a") + F.col("b") * at
    return steps.select(
        "cluster_id", F.make_date(at.cast("int"), F.lit(1), F.lit(1)).alias("forecast_timestamp"),
        mean.alias("forecast_value"), (mean - half).alias("prediction_interval_lower_bound"),
        (mean + half).alias("prediction_interval_upper_bound"),
    )


def trend_fit(counts: DataFrame) -> DataFrame:
    """Fit quality per series."""
    x, v = F.year("yr").cast("double"), F.col("n_docs").cast("double")
    s = counts.groupBy("cluster_id").agg(
        F.regr_count(v, x).alias("n_years"), F.regr_r2(v, x).alias("r2"),
        F.regr_sxx(v, x).alias("sxx"), F.regr_syy(v, x).alias("syy"), F.regr_sxy(v, x).alias("sxy"),
    )
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")))
    return s.select("cluster_id", "n_years", "r2", F.sqrt(rest / F.col("n_years")).alias("rmse"))


def autoregressive(counts: DataFrame, horizon: int = 3, confidence: float = 0.8) -> DataFrame:
    """AR(1) with drift on yearly differences, fitted per cluster.

    A group is one series of yearly counts, so its size is the number of years.
    """
    z = interval_z(confidence)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        v = pdf["n"].to_numpy(float)
        d = np.diff(v)
        phi, drift, sigma = 0.0, float(d.mean()) if len(d) else 0.0, float(d.std(ddof=1)) if len(d) > 1 else 0.0
        if len(d) > 3 and np.ptp(d[:-1]) > 0:
            phi, drift = np.polyfit(d[:-1], d[1:], 1)
            phi = float(np.clip(phi, -0.95, 0.95))
            sigma = float(np.std(d[1:] - (phi * d[:-1] + drift), ddof=min(2, len(d) - 2)))
        level, step, out, var, psi = v[-1], d[-1] if len(d) else 0.0, [], 0.0, 0.0
        for h in range(1, horizon + 1):
            step = phi * step + drift
            level = level + step
            psi += phi ** (h - 1)
            var += (sigma * psi) ** 2
            half = z * var**0.5
            out.append((int(pdf["cluster_id"].iloc[0]), int(pdf["y"].iloc[-1]) + h, level, level - half, level + half))
        return pd.DataFrame(out, columns=["cluster_id", "year", "forecast", "lo", "hi"])

    flat = counts.select("cluster_id", F.year("yr").alias("y"), F.col("n_docs").cast("double").alias("n"))
    return flat.groupBy("cluster_id").applyInPandas(fit, "cluster_id bigint, year int, forecast double, lo double, hi double")


def trend_with_drivers(series: DataFrame, future: DataFrame, drivers: list[str]) -> DataFrame:
    """Least squares of n_docs on year and further columns, per cluster; `future` holds the drivers ahead.

    Both sides of a group hold one row per year.
    """

    def fit(past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        if past.empty or ahead.empty:
            return pd.DataFrame({"cluster_id": [], "year": [], "forecast": []})
        cols = ["year", *drivers]
        x = np.column_stack([np.ones(len(past)), past[cols].to_numpy(float)])
        beta, *_ = np.linalg.lstsq(x, past["n_docs"].to_numpy(float), rcond=None)
        f = np.column_stack([np.ones(len(ahead)), ahead[cols].to_numpy(float)]) @ beta
        return pd.DataFrame({"cluster_id": ahead["cluster_id"], "year": ahead["year"], "forecast": f})

    future = future.toDF(*future.columns)  # new column ids, as `future` usually derives from `series`
    return series.groupBy("cluster_id").cogroup(future.groupBy("cluster_id")).applyInPandas(fit, "cluster_id bigint, year int, forecast double")
