"""Model queries. Fitted models are checked by row counts, everything around them by SQL."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.functions.hashing import split_of
from siftmap.operators import arima, datasets, labeling, living, registry, shapley, vector
from siftmap.operators import learning as op
from siftmap.operators.evidence import centroids
from siftmap.session import new_path

# the supplied vectors carry their cluster, so "belongs to one of the first five clusters" is a
# label a model can learn
TARGET = "cluster_id < 5"


def examples(d):
    """doc_id, row_id, embedding, a 0/1 label, the cluster, a number, and the split."""
    e = d.raw("embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding", F.col("label").cast("bigint").alias("cluster_id"))
    first = F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double")
    return e.select(
        "doc_id", F.col("doc_id").alias("row_id"), "embedding", F.expr(TARGET).cast("int").alias("label"), "cluster_id", first.alias("amount"),
        split_of(F.col("doc_id")).alias("split"),
    )


def screening_data(d):
    return datasets.screening(d.corpus(), d.embeddings(), d.screening_labels()).select(
        F.col("row_id").alias("doc_id"), "row_id", "embedding", "label", split_of(F.col("row_id")).alias("split")
    )


SCREEN = op.Recipe("classification", "LOGISTIC_REG")
LIGHT = op.Recipe("classification", "LOGISTIC_REG", settings={"l2_reg": 0.01})


#: Documents per cluster and year; a run passes if forecasts of the last years were off by less than half of the values.
VOLUME = op.Recipe("time_series", "ARIMA_PLUS", bounds={"mean_absolute_percentage_error_max": 0.5}, series=arima.Series("yr", "n_docs", "cluster_id"))


def yearly_counts(d):
    return living.yearly(d.clusters(), d.corpus().select("doc_id", "year"))


def as_rows(spark, trained, name):
    rows = [(name, k, float(v)) for k, v in trained.metrics.items()]
    return spark.createDataFrame(rows, "model string, metric string, value double").withColumn("passed", F.lit(trained.passed).cast("boolean"))


@query("screening_model_fit")
def _(d):
    m = op.train(screening_data(d), SCREEN).model.stages[0]
    coef = [(i, float(c)) for i, c in enumerate([m.intercept, *m.coefficients.toArray()])]
    return d.spark.createDataFrame(coef, "position int, coefficient double")


@query("screening_model_predict")
def _(d):
    m = op.train(screening_data(d), SCREEN).model
    return op.p_positive(m.transform(op.features(d.embeddings(), ["embedding"]))).select("doc_id", "p_relevant")


@query("screening_model_eval", """WITH l AS (SELECT vec_id::VARCHAR AS doc_id, (label < 5)::INTEGER AS label FROM embeddings), s AS (SELECT l.label, p_relevant AS p FROM l JOIN scores k ON k.doc_id = l.doc_id),
 r AS (SELECT label, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE) AS rk, p FROM s),
 m AS (SELECT count_if(p >= 0.5 AND label = 1) / count_if(p >= 0.5) AS pr, count_if(p >= 0.5 AND label = 1) / count_if(label = 1) AS re,
  (sum(CASE WHEN label = 1 THEN rk END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2) / (count_if(label = 1)::DOUBLE * count_if(label = 0)) AS auc FROM r)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1_score, round(auc, 6) AS roc_auc FROM m""")
def _(d):
    scored = d.scores().select("p_relevant", F.expr(TARGET).cast("int").alias("label"))
    m = op.binary_metrics(scored)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("kmeans_fit")
def _(d):
    return op.fit_kmeans(d.clustered(), k=14)


@query("kmeans_assign_fitted")
def _(d):
    return vector.assign(d.clustered(), op.fit_kmeans(d.clustered(), k=14))


@query("logreg_multiclass")
def _(d):
    cfg = op.Recipe("classification", "LOGISTIC_REG", op.Examples(label="cluster_id"), {"l2_reg": 0.01})
    return as_rows(d.spark, op.train(examples(d), cfg), "LOGISTIC_REG")


@query("classification_models")
def _(d):
    out = None
    for kind in op.MODEL_TYPES["classification"]:
        cfg = op.Recipe("classification", kind, settings={"l2_reg": 0.01} if kind == "LOGISTIC_REG" else {})
        rows = as_rows(d.spark, op.train(examples(d), cfg), kind)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("regression_models")
def _(d):
    out = None
    for kind in op.MODEL_TYPES["regression"]:
        cfg = op.Recipe("regression", kind, op.Examples(label="amount"), {"l2_reg": 0.001} if kind == "LINEAR_REG" else {})
        rows = as_rows(d.spark, op.train(examples(d), cfg), kind)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("pca_reduce")
def _(d):
    cfg = op.Recipe("dimensionality_reduction", "PCA")
    m = op.train(examples(d), cfg).model
    return m.transform(op.features(d.embeddings(), ["embedding"])).select("doc_id", op.vector_to_array("reduced").alias("reduced"))


@query("anomaly_score")
def _(d):
    cfg = op.Recipe("anomaly_detection", "AUTOENCODER")
    m = op.train(examples(d), cfg).model
    scored = op.reconstruction_error(m.transform(op.features(d.embeddings(), ["embedding"])))
    return op.anomalies(scored).select("doc_id", "anomaly", "is_anomaly")


@query("anomaly_score_centroid", """WITH a AS (SELECT doc_id, dist_to_centroid AS anomaly FROM doc_clusters), c AS (SELECT quantile_disc(anomaly, 0.98) AS q FROM a)
SELECT doc_id, round(anomaly, 6) AS anomaly, round(anomaly, 9) > round((SELECT q FROM c), 9) AS is_anomaly FROM a""")
def _(d):
    a = vector.assign(d.clustered(), centroids(d.clustered())).withColumnRenamed("dist_to_centroid", "anomaly")
    return op.anomalies(a).select("doc_id", F.round("anomaly", 6).alias("anomaly"), "is_anomaly")


@query("train_config_run")
def _(d):
    """One run end to end: the model is saved, and run, model and evaluation rows are appended to a registry and read back."""
    started = datetime.now(timezone.utc)
    t = op.train(examples(d), LIGHT)
    path, root = new_path(d.spark, "model"), new_path(d.spark, "registry")
    t.model.save(path)
    rows = op.run_rows(d.spark, LIGHT, t, "run-1", "screening", path, started, datetime.now(timezone.utc))
    for name, frame in zip(("runs", "models", "evaluations"), rows):
        frame.write.mode("append").parquet(f"{root}/{name}")
    runs, models, evaluations = (d.spark.read.schema(f.schema).parquet(f"{root}/{n}") for n, f in zip(("runs", "models", "evaluations"), rows))
    return registry.check_gates(evaluations, op.GATES["classification"]).join(models, "model_id").join(runs.drop("learning_type"), "run_id").select(
        "run_id", "model_id", "task", "learning_type", "status", "config_json", "metrics_json", "passed")


@query("evidence_type_model")
def _(d):
    """Evidence types are text: a model of several classes, its metrics on the test split and how many labels it names."""
    data = datasets.evidence_type(d.corpus(), d.embeddings()).withColumn("split", split_of(F.col("row_id")))
    t = op.train(data, op.Recipe("classification", "LOGISTIC_REG", settings={"l2_reg": 0.01}))
    named = t.model.transform(op.features(data, ["embedding"])).groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))
    return named.withColumn("recall", F.lit(t.metrics["recall"]))


@query("training_data_select", """SELECT vec_id::VARCHAR AS row_id, g.label, round(list_sum(embedding::DOUBLE[]), 4) AS vec_sum FROM embeddings JOIN gold g ON g.task_id = 'task_1' AND g.row_id = vec_id::VARCHAR
WHERE ('0x'||substr(md5(vec_id::VARCHAR),1,8))::BIGINT % 100 < 70""")
def _(d):
    rows = op.training_rows(examples(d), SCREEN, "train", gold=labeling.gold(d.annotations().filter("task_id = 'task_1'")), keep=("row_id",))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("row_id", "label", F.round(total, 4).alias("vec_sum"))


@query("training_data_select_series", "SELECT yr, n_docs, cluster_id FROM cluster_yearly")
def _(d):
    return op.training_rows(yearly_counts(d), VOLUME)


@query("train_time_series_run")
def _(d):
    """A run over a table of series: models saved as a table, run, model and evaluation rows in a registry, the gate, and the saved models' forecast."""
    started = datetime.now(timezone.utc)
    t = op.train(yearly_counts(d), VOLUME)
    path, root = new_path(d.spark, "model"), new_path(d.spark, "registry")
    t.model.write.parquet(path)
    rows = op.run_rows(d.spark, VOLUME, t, "run-ts", "cluster_volume", path, started, datetime.now(timezone.utc))
    for name, frame in zip(("runs", "models", "evaluations"), rows):
        frame.write.mode("append").parquet(f"{root}/{name}")
    runs, models, evaluations = (d.spark.read.schema(f.schema).parquet(f"{root}/{n}") for n, f in zip(("runs", "models", "evaluations"), rows))
    gated = registry.check_gates(evaluations, op.GATES["time_series"] | VOLUME.bounds).join(models, "model_id").join(runs.drop("learning_type"), "run_id")
    saved = d.spark.read.schema(t.model.schema).parquet(gated.head()["artifact"])
    ahead = op.series_forecast(saved, VOLUME).agg(F.count("forecast_value").alias("n_forecasts"), F.countDistinct("series").alias("n_forecast_series"))
    return gated.select("run_id", "model_id", "task", "learning_type", "status", "config_json", "metrics_json", "passed").crossJoin(F.broadcast(ahead))


@query("hparam_search")
def _(d):
    cfg = op.Recipe("classification", "LOGISTIC_REG", candidates=op.Candidates({"l2_reg": [0.001, 1.0]}, 4))
    t = op.train(examples(d), cfg)
    return d.spark.createDataFrame([(i, json.dumps(s), float(v)) for i, (s, v) in enumerate(t.trials)], "trial_id int, hyperparameters string, objective double")


@query("hparam_search_density")
def _(d):
    """Trials proposed in rounds by what earlier ones measured."""
    cfg = op.Recipe("regression", "LINEAR_REG", op.Examples(label="amount"), candidates=op.Candidates({"l1_reg": [1e-6, 1.0], "l2_reg": [1e-6, 10.0]}, 12, by="density"))
    t = op.train(examples(d), cfg)
    return d.spark.createDataFrame([(i, json.dumps(s), float(v)) for i, (s, v) in enumerate(t.trials)], "trial_id int, hyperparameters string, objective double")


@query("global_explain")
def _(d):
    cfg = LIGHT
    data = examples(d)
    return op.explain(op.train(data, cfg).model, op.features(op.training_rows(data, cfg), ["embedding"]))


@query("global_explain_shapley")
def _(d):
    """Mean absolute Shapley value of each feature of boosted trees, over all training rows."""
    cfg = op.Recipe("regression", "BOOSTED_TREE_REGRESSOR", op.Examples(label="amount"), {"max_iterations": 10, "max_tree_depth": 4})
    data = examples(d)
    model = op.train(data, cfg).model.stages[0]
    return shapley.mean_influence(shapley.read(model, d.spark), op.features(op.training_rows(data, cfg), ["embedding"]))


@query("predict_production")
def _(d):
    """A model is saved, promoted to production, found through the alias, and applied."""
    cfg = LIGHT
    t = op.train(examples(d), cfg)
    path = new_path(d.spark, "model")
    t.model.save(path)
    models = d.spark.createDataFrame([("m1", "screening", path, "classification")], "model_id string, task string, artifact string, learning_type string")
    asked = d.spark.createDataFrame([("p1", "m1", "screening", "production", 1)], "promotion_id string, model_id string, task string, to_stage string, promoted_at int")
    alias = registry.production(registry.model_stages(models, asked)).filter("task = 'screening'").head()
    model = PipelineModel.load(alias["artifact"])
    return op.p_positive(model.transform(op.features(d.embeddings(), ["embedding"]))).select("doc_id", "p_relevant", "prediction")
