"""Living-evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.operators import arima
from siftmap.operators import living as op

Z = op.interval_z(0.8)
TREND = f"""SELECT cluster_id, h, (last + h)::INTEGER AS year, a + b * (last + h) AS fc,
 {Z!r}::DOUBLE * sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) * (1 + 1.0::DOUBLE / n + (last + h - mx) * (last + h - mx) / sxx)) AS half
FROM (SELECT cluster_id, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, regr_avgx(v, x) AS mx, regr_sxx(v, x) AS sxx, regr_syy(v, x) AS syy, regr_sxy(v, x) AS sxy, count(*) AS n, max(x) AS last
  FROM (SELECT cluster_id, year(yr)::DOUBLE AS x, n_docs::DOUBLE AS v FROM cluster_yearly) GROUP BY cluster_id), (VALUES (1), (2), (3)) t(h)"""


def counts(d):
    return op.yearly(d.clusters(), d.corpus().select("doc_id", "year"))


@query("cluster_yearly", "SELECT * FROM cluster_yearly")
def _(d):
    return counts(d)


@query("filter_year_range", "SELECT doc_id, year FROM corpus WHERE year IS NOT NULL AND year BETWEEN 2005 AND (SELECT max(year) FROM corpus)")
def _(d):
    years = d.corpus().select("doc_id", "year")
    return years.filter(F.col("year").isNotNull() & F.col("year").between(2005, years.agg(F.max("year")).scalar()))


PAIRS = """SELECT k.doc_id, k.cluster_id, p.y FROM clusters k JOIN (SELECT doc_id, 2005 + (n % 20) AS y FROM (SELECT user_id::VARCHAR AS doc_id, event_id // 50 AS n FROM events)) p ON k.doc_id = p.doc_id"""


@query("cluster_yearly_distinct", f"SELECT cluster_id, make_date(y::INTEGER, 1, 1) AS yr, count(DISTINCT doc_id) AS n_docs FROM ({PAIRS}) GROUP BY ALL")
def _(d):
    years = d.raw("events").select(
        F.col("user_id").cast("string").alias("doc_id"), (2005 + F.floor(F.col("event_id") / 50) % 20).cast("int").alias("publication_year")
    )
    return op.yearly_distinct(d.clusters(), years)


@query("publication_year_extract", rf"""SELECT doc_id, TRY_CAST(y AS BIGINT) AS publication_year, 'explicit_publication_label' AS extraction_method
FROM (SELECT doc_id, regexp_extract(lower(abstract), '{op.YEAR_LABEL}', 1) AS y FROM (
  SELECT doc_id, abstract || ' Published: ' || (year - 60) || CASE WHEN year % 2 = 0 THEN ' (publication year ' || year || ')' ELSE '' END AS abstract FROM corpus)) WHERE y <> ''""")
def _(d):
    # the supplied prose carries no year labels, so each text gets one from its own year column
    text = F.concat(
        "abstract", F.lit(" Published: "), (F.col("year") - 60).cast("string"),
        F.when(F.col("year") % 2 == 0, F.concat(F.lit(" (publication year "), F.col("year").cast("string"), F.lit(")"))).otherwise(F.lit("")),
    )
    return op.publication_years(d.corpus().select("doc_id", text.alias("abstract")))


@query("forecast_yearly", f"SELECT cluster_id, make_date(year, 1, 1) AS forecast_timestamp, round(fc, 4) AS forecast_value, round(fc - half, 4) AS lo, round(fc + half, 4) AS hi FROM ({TREND})")
def _(d):
    return op.trend(counts(d)).select(
        "cluster_id", "forecast_timestamp", F.round("forecast_value", 4).alias("forecast_value"),
        F.round("prediction_interval_lower_bound", 4).alias("lo"), F.round("prediction_interval_upper_bound", 4).alias("hi"),
    )


@query("living_forecast", f"SELECT cluster_id, year, round(fc, 1) AS forecast, round(fc - half, 1) AS lo, round(fc + half, 1) AS hi FROM ({TREND}) ORDER BY 1, 2")
def _(d):
    return op.trend(counts(d)).select(
        "cluster_id", F.year("forecast_timestamp").alias("year"), F.round("forecast_value", 1).alias("forecast"),
        F.round("prediction_interval_lower_bound", 1).alias("lo"), F.round("prediction_interval_upper_bound", 1).alias("hi"),
    ).orderBy("cluster_id", "year")


@query("living_history", "SELECT cluster_id, year(yr)::INTEGER AS year, n_docs FROM cluster_yearly ORDER BY 1, 2")
def _(d):
    return counts(d).select("cluster_id", F.year("yr").alias("year"), "n_docs").orderBy("cluster_id", "year")


@query("forecast_eval", """SELECT cluster_id, count(*) AS n_years, round(regr_r2(v, x), 9) AS r2,
 round(sqrt(greatest(0, regr_syy(v, x) - regr_sxy(v, x) * regr_sxy(v, x) / regr_sxx(v, x)) / count(*)), 9) AS rmse
FROM (SELECT cluster_id, year(yr)::DOUBLE AS x, n_docs::DOUBLE AS v FROM cluster_yearly) GROUP BY cluster_id""")
def _(d):
    return op.trend_fit(counts(d)).select("cluster_id", "n_years", F.round("r2", 9).alias("r2"), F.round("rmse", 9).alias("rmse"))


@query("forecast_autoregressive")
def _(d):
    return op.autoregressive(counts(d))


SERIES = arima.Series("yr", "n_docs", "cluster_id")


@query("forecast_arima")
def _(d):
    """Automatic ARIMA per cluster: three years ahead at 80 per cent."""
    return arima.forecast(arima.fit(counts(d), SERIES), 3, 0.8).withColumnRenamed("series", "cluster_id")


@query("forecast_arima_horizon", """SELECT c.cluster_id, n_points, make_date(last + h, 1, 1) AS forecast_timestamp, h > 0 AS has_value FROM
 (SELECT cluster_id, (max(year(yr)) - min(year(yr)) + 1)::INTEGER AS n_points, max(year(yr))::INTEGER AS last FROM cluster_yearly GROUP BY 1) c, (VALUES (1), (2), (3)) t(h)""")
def _(d):
    """What the forecast covers: the years after each series' last one, and how many years the model has seen, gaps filled."""
    models = arima.fit(counts(d), SERIES)
    ahead = arima.forecast(models, 3).select(F.col("series").alias("of"), "forecast_timestamp", F.col("forecast_value").isNotNull().alias("has_value"))
    return models.join(ahead, F.col("series") == F.col("of")).select(F.col("series").alias("cluster_id"), "n_points", "forecast_timestamp", "has_value")


@query("forecast_arima_eval")
def _(d):
    """Orders, likelihood, criterion and variance per cluster."""
    return arima.residual_report(arima.fit(counts(d), SERIES)).withColumnRenamed("series", "cluster_id")


@query("forecast_arima_xreg")
def _(d):
    """ARIMA with the corpus' documents per year as a driver, which stays at its mean ahead."""
    past = counts(d).withColumn("year", F.year("yr")).join(drivers(d), "year")
    last = past.groupBy("cluster_id").agg(F.max("year").alias("y"), F.avg("corpus_docs").alias("corpus_docs"))
    ahead = last.select("cluster_id", F.explode(F.sequence(F.col("y") + 1, F.col("y") + 3)).alias("year"), "corpus_docs")
    future = ahead.withColumn("yr", F.make_date("year", F.lit(1), F.lit(1)))
    driven = arima.Series("yr", "n_docs", "cluster_id", ("corpus_docs",))
    return arima.forecast(arima.fit(past, driven), 3, future=future, series=driven).withColumnRenamed("series", "cluster_id")


def drivers(d):
    """Documents per year in the whole corpus, as the outside driver of each cluster."""
    return d.corpus().groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("corpus_docs"))


@query("forecast_xreg")
def _(d):
    past = counts(d).select("cluster_id", F.year("yr").alias("year"), F.col("n_docs").cast("double").alias("n_docs")).join(drivers(d), "year")
    last = past.groupBy("cluster_id").agg(F.max("year").alias("y"), F.avg("corpus_docs").alias("corpus_docs"))
    ahead = last.select("cluster_id", F.explode(F.sequence(F.col("y") + 1, F.col("y") + 3)).alias("year"), "corpus_docs")
    return op.trend_with_drivers(past, ahead, ["corpus_docs"])


ALERTS = f"""SELECT l.cluster_id, l.label, l.sector, b.n_before_ar6, b.n_since_ar6, round(f.s, 4) AS n_forecast_3y, round(b.n_since_ar6 / b.n_before_ar6, 6) AS growth_since_ar6,
 CASE WHEN b.n_since_ar6 / b.n_before_ar6 >= 0.5 THEN 'update_now' WHEN b.n_since_ar6 / b.n_before_ar6 >= 0.25 THEN 'watch' ELSE 'stable' END AS update_status
FROM cluster_labels l LEFT JOIN (SELECT cluster_id, sum(CASE WHEN year(yr) <= 2021 THEN n_docs END)::BIGINT AS n_before_ar6, sum(CASE WHEN year(yr) > 2021 THEN n_docs END)::BIGINT AS n_since_ar6 FROM cluster_yearly GROUP BY 1) b ON b.cluster_id = l.cluster_id
LEFT JOIN (SELECT cluster_id, sum(fc) AS s FROM ({TREND}) GROUP BY 1) f ON f.cluster_id = l.cluster_id"""


def alerts(d):
    return op.alerts(d.cluster_labels(), counts(d), op.trend(counts(d)))


def show(df):
    return df.withColumn("n_forecast_3y", F.round("n_forecast_3y", 4)).withColumn("growth_since_ar6", F.round("growth_since_ar6", 6))


@query("living_evidence_alerts", ALERTS)
def _(d):
    return show(alerts(d))


@query("living_evidence_alerts_bootstrap", """SELECT b.cluster_id, l.label, l.sector, b.n_before_ar6, b.n_since_ar6, NULL::DOUBLE AS n_forecast_3y, round(n_since_ar6 / nullif(n_before_ar6, 0) - 1, 6) AS growth_since_ar6,
 CASE WHEN yrs < 3 THEN 'insufficient_data' WHEN n_since_ar6 / nullif(n_before_ar6, 0) - 1 >= 0.5 THEN 'update_now' WHEN n_since_ar6 / nullif(n_before_ar6, 0) - 1 >= 0.25 THEN 'watch' ELSE 'stable' END AS update_status
FROM (SELECT cluster_id, count(DISTINCT year(yr)) AS yrs, sum(CASE WHEN year(yr) < 2021 THEN n_docs ELSE 0 END)::BIGINT AS n_before_ar6, sum(CASE WHEN year(yr) >= 2021 THEN n_docs ELSE 0 END)::BIGINT AS n_since_ar6 FROM cluster_yearly GROUP BY 1) b
LEFT JOIN cluster_labels l ON l.cluster_id = b.cluster_id""")
def _(d):
    return show(op.alerts_plain(counts(d), d.cluster_labels()))


@query("alert_status_counts", f"SELECT update_status, count(*) AS n_clusters FROM ({ALERTS}) GROUP BY 1")
def _(d):
    return alerts(d).groupBy("update_status").agg(F.count(F.lit(1)).alias("n_clusters"))


@query("order_nulls_last", f"SELECT cluster_id, growth_since_ar6, update_status FROM ({ALERTS}) ORDER BY growth_since_ar6 DESC NULLS LAST, cluster_id")
def _(d):
    return show(alerts(d)).select("cluster_id", "growth_since_ar6", "update_status").orderBy(F.desc_nulls_last("growth_since_ar6"), "cluster_id")


@query("empty_relation", "SELECT l.cluster_id, l.n_docs, NULL::DOUBLE AS n_forecast_3y FROM cluster_labels l")
def _(d):
    none = d.spark.createDataFrame([], "cluster_id bigint, forecast_timestamp date, forecast_value double")
    return d.cluster_labels().select("cluster_id", "n_docs").join(
        none.groupBy("cluster_id").agg(F.sum("forecast_value").alias("n_forecast_3y")), "cluster_id", "left"
    )
