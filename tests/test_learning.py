import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmap.operators import learning as op


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(240):
        y = i % 3 == 0
        v = r.normal(size=4) + (2.0 if y else 0.0)
        rows.append((f"d{i}", [float(x) for x in v], int(y), int(i % 4), float(v.sum()), "test" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "doc_id string, embedding array<double>, label int, kind int, amount double, split string").withColumn("row_id", F.col("doc_id")).cache()


def cfg(kind, model, label="label", search=None, trials=0, **settings):
    return op.Recipe(kind, model, op.Examples(label=label), settings, op.Candidates(search, trials) if search else None)


def test_recipe_rules(data):
    assert not cfg("classification", "LOGISTIC_REG", l2_reg=1.0, search={"l1_reg": [0.1]}).problems()
    for bad in (
        cfg("clustering", "LOGISTIC_REG"), cfg("classification", "LOGISTIC_REG", search={"nope": [1]}), cfg("classification", "LOGISTIC_REG", label=""),
        cfg("classification", "DNN_CLASSIFIER", learn_rate=0.1), cfg("classification", "DNN_CLASSIFIER", search={"dropout": [0.1, 0.5]}),
        cfg("classification", "LOGISTIC_REG", search={"max_iterations": [1, 2]}),
    ):
        assert bad.problems()
        with pytest.raises(ValueError):
            op.train(data, bad)


def test_text_labels(data):
    named = data.withColumn("label", F.when(F.col("label") == 1, "yes").otherwise("no"))
    t = op.train(named, cfg("classification", "LOGISTIC_REG", l2_reg=0.01))
    assert t.labels == ["no", "yes"] and t.metrics["roc_auc"] > 0.85
    out = t.model.transform(op.features(named, ["embedding"])).select("label", "predicted_label").collect()
    assert sum(r.label == r.predicted_label for r in out) > 0.8 * len(out)
    three = data.withColumn("label", F.when(F.col("kind") < 2, F.format_string("k%d", "kind")).when(F.col("split") == "test", "only in test").otherwise("more"))
    assert sorted(op.train(three, cfg("classification", "LOGISTIC_REG")).labels) == ["k0", "k1", "more"]


def test_all_columns_but_some_are_features(data):
    source = op.Examples(features=None, label="amount", leave_out=("kind",))
    assert source.columns(data) == ["embedding", "label"]


def test_run_rows(spark, data):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    recipe = cfg("regression", "LINEAR_REG", label="amount", l2_reg=0.0)
    run, model, scores = op.run_rows(spark, recipe, op.train(data, recipe), "r1", "t", "path", at, at)
    assert run.head().status == "succeeded" and model.head().run_id == "r1" and scores.head().model_id == model.head().model_id


def test_class_weights_even_out(data):
    w = op.balanced(data).groupBy("label").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert all(round(r.w, 6) == 120 for r in w)


@pytest.mark.parametrize("ties", [False, True])
def test_binary_metrics_equal_brute_force(spark, ties):
    r = random.Random(4)
    pairs = [(round(r.random(), 1) if ties else r.random(), int(r.random() < 0.4)) for _ in range(150)]
    got = op.binary_metrics(spark.createDataFrame(pairs, "p_relevant double, label int")).head()
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    tp, fp = sum(p >= 0.5 for p in pos), sum(p >= 0.5 for p in neg)
    assert round(got.roc_auc, 9) == round(auc, 9)
    assert round(got.precision, 9) == round(tp / (tp + fp), 9) and round(got.recall, 9) == round(tp / len(pos), 9)


@pytest.mark.parametrize(
    "model,hp",
    [
        ("LOGISTIC_REG", {"l2_reg": 0.01}), ("BOOSTED_TREE_CLASSIFIER", {"max_iterations": 3, "max_tree_depth": 3}),
        ("RANDOM_FOREST_CLASSIFIER", {"num_parallel_tree": 5, "max_tree_depth": 4}), ("DNN_CLASSIFIER", {"hidden_units": [8], "max_iterations": 40}),
    ],
)
def test_classifiers_learn(data, model, hp):
    t = op.train(data, cfg("classification", model, **hp))
    assert t.metrics["roc_auc"] > 0.85 and t.passed in (True, False)


@pytest.mark.parametrize(
    "model,hp",
    [("LINEAR_REG", {"l2_reg": 0.0}), ("BOOSTED_TREE_REGRESSOR", {"max_iterations": 5}), ("RANDOM_FOREST_REGRESSOR", {"num_parallel_tree": 10})],
)
def test_regressors_learn(data, model, hp):
    assert op.train(data, cfg("regression", model, label="amount", **hp)).metrics["r2_score"] > 0.5


def test_many_classes(data):
    t = op.train(data, cfg("classification", "BOOSTED_TREE_CLASSIFIER", label="kind", max_iterations=1, max_tree_depth=2))
    assert 0 <= t.metrics["accuracy"] <= 1


def test_clusters_components_and_anomalies(data):
    k = op.train(data, cfg("clustering", "KMEANS", num_clusters=3))
    assert k.metrics["davies_bouldin_index"] > 0
    p = op.train(data, cfg("dimensionality_reduction", "PCA", num_principal_components=4))
    assert round(p.metrics["total_explained_variance_ratio"], 6) == 1.0 and p.passed
    full = op.reconstruction_error(p.model.transform(op.features(data, ["embedding"])))
    assert full.agg(F.max("anomaly")).head()[0] < 1e-9
    part = op.train(data, cfg("anomaly_detection", "AUTOENCODER", hidden_units=[3, 1, 3]))
    odd = op.anomalies(op.reconstruction_error(part.model.transform(op.features(data, ["embedding"]))), share=0.1)
    assert 10 <= odd.filter("is_anomaly").count() <= 30


def test_grid_tries_every_candidate():
    found = op.grid({"l1_reg": [1, 2, 3], "l2_reg": [4, 5, 6]}, 4)
    assert len(found) == 4 and {f["l1_reg"] for f in found} == {1, 2, 3} and {f["l2_reg"] for f in found} == {4, 5, 6}


def test_grid():
    assert op.grid({"l2_reg": [0.01, 1.0]}, 3) == [{"l2_reg": pytest.approx(v)} for v in (0.01, 0.1, 1.0)]
    assert op.grid({"subsample": [0.5, 1.0]}, 3) == [{"subsample": 0.5}, {"subsample": 0.75}, {"subsample": 1.0}]
    assert op.grid({"max_tree_depth": [2, 4]}, 3) == [{"max_tree_depth": 2}, {"max_tree_depth": 3}, {"max_tree_depth": 4}]
    assert op.grid({"hidden_units": [[8], [16], [4]]}, 3) == [{"hidden_units": [8]}, {"hidden_units": [16]}, {"hidden_units": [4]}]


def test_search_fits_the_best_setting(data):
    t = op.train(data, cfg("regression", "LINEAR_REG", label="amount", search={"l2_reg": [0.001, 100.0]}, trials=3))
    assert len(t.trials) == 3
    best = max(t.trials, key=lambda r: r[1])[0]
    assert best == {"l2_reg": 0.001} and t.model.stages[0].getRegParam() == 0.001


def test_explain_finds_the_driving_feature(spark):
    r = np.random.default_rng(2)
    rows = [([float(x) for x in v], float(3 * v[2] + 0.1 * v[0])) for v in r.normal(size=(200, 4))]
    df = op.features(spark.createDataFrame(rows, "embedding array<double>, label double"), ["embedding"])
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[op.estimator("LINEAR_REG", {"l2_reg": 0.0, "max_iterations": 20})]).fit(df)
    top = op.explain(model, df, 2).collect()
    assert [t.feature for t in top] == [2, 0]


def test_gold_labels_replace_the_column(spark, data):
    gold = spark.createDataFrame([("d1", "x"), ("d5", "y")], "row_id string, label string")
    got = op.training_rows(data, cfg("classification", "LOGISTIC_REG"), "train", gold, keep=("row_id",)).collect()
    assert [(r.row_id, r.label) for r in got] == [("d1", "x")]
    unlabelled = data.withColumn("label", F.when(F.col("label") == 1, 1))
    assert op.training_rows(unlabelled, cfg("classification", "LOGISTIC_REG"), "train").filter("label IS NULL").count() == 0


def test_mixed_features(data):
    df = op.features(data, ["embedding", "amount"])
    assert df.select(F.size(op.vector_to_array("features")).alias("n")).head().n == 5


def test_embedding_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([("a", "flood risk in cities"), ("b", "flood risk in cities"), ("c", "other words")], "k string, t string")
    got = {r.k: np.array(r.embedding) for r in op.embed_text(df, "k", "t", 64).collect()}
    assert np.allclose(got["a"], got["b"]) and np.isclose(np.linalg.norm(got["c"]), 1.0)


def test_recipes_over_series(spark):
    import datetime as dt

    from siftmap.operators.arima import Series

    rows = [(c, dt.date(1990 + k, 1, 1), float(10 * c + 2 * k + (k * 7 % 3)), float(k % 4)) for c in (1, 2, 3) for k in range(16)]
    data = spark.createDataFrame(rows, "cluster_id bigint, yr date, n_docs double, x double")
    s = Series("yr", "n_docs", "cluster_id")
    good = op.Recipe("time_series", "ARIMA_PLUS", settings={"horizon": 2}, bounds={"mean_absolute_percentage_error_max": 0.3}, series=s)
    t = op.train(data, good)
    assert t.passed and t.metrics["n_series"] == 3 and t.metrics["n_compared"] == 6 and t.metrics["mean_absolute_error"] < 4
    assert op.training_rows(data, good).columns == ["yr", "n_docs", "cluster_id"]
    ahead = op.series_forecast(t.model, good).collect()
    assert len(ahead) == 6 and all(r.prediction_interval_lower_bound <= r.forecast_value <= r.prediction_interval_upper_bound for r in ahead)
    run, model, scores = op.run_rows(spark, good, t, "r1", "volume", "/models/r1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    assert run.head().learning_type == "time_series" and model.head().artifact == "/models/r1" and "n_series" in scores.head().metrics_json
    fixed = op.Recipe("time_series", "ARIMA_PLUS", settings={"auto_arima": False, "non_seasonal_order": [0, 1, 1]}, series=s)
    assert {(r.p, r.d, r.q) for r in op.train(data, fixed).model.collect()} == {(0, 1, 1)}
    driven = op.Recipe("time_series", "ARIMA_PLUS_XREG", series=Series("yr", "n_docs", "cluster_id", ("x",)))
    assert op.train(data, driven).metrics["n_series"] == 3
    for bad in (
        op.Recipe("time_series", "ARIMA_PLUS"), op.Recipe("time_series", "LINEAR_REG", series=s), op.Recipe("time_series", "ARIMA_PLUS", settings={"auto_arima": False}, series=s),
        op.Recipe("time_series", "ARIMA_PLUS", settings={"data_frequency": "HOURLY"}, series=s), op.Recipe("time_series", "ARIMA_PLUS_XREG", series=s),
        op.Recipe("time_series", "ARIMA_PLUS", candidates=op.Candidates({"horizon": [1, 2]}, 2), series=s), op.Recipe("time_series", "ARIMA_PLUS", settings={"holiday_region": "US"}, series=s),
    ):
        assert bad.problems()
