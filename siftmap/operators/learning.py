"""Models with Spark ML: one recipe for every kind of learning, metrics and bounds.

Regularisation strengths follow Spark's scaling; scores therefore resemble, but do not equal,
those of other engines with the same numbers.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, IDF, HashingTF, IndexToString, Normalizer, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.functions.hashing import holdout_of
from siftmap.functions.vectors import as_double
from siftmap.operators import arima, registry, suggest, vector
from siftmap.plans.ordering import global_order
from siftmap.session import new_path

# Model types per learning type, their default settings, what may be searched,
# and the default quality gates.
MODEL_TYPES = {
    "classification": ["LOGISTIC_REG", "BOOSTED_TREE_CLASSIFIER", "DNN_CLASSIFIER", "RANDOM_FOREST_CLASSIFIER"],
    "regression": ["LINEAR_REG", "BOOSTED_TREE_REGRESSOR", "RANDOM_FOREST_REGRESSOR"],
    "clustering": ["KMEANS"],
    "dimensionality_reduction": ["PCA"],
    "anomaly_detection": ["AUTOENCODER", "KMEANS"],
    "time_series": ["ARIMA_PLUS", "ARIMA_PLUS_XREG"],
}
DEFAULTS: dict[str, dict[str, Any]] = {
    "LOGISTIC_REG": {"l1_reg": 0.0, "l2_reg": 0.5, "max_iterations": 20, "auto_class_weights": True},
    "LINEAR_REG": {"l1_reg": 0.0, "l2_reg": 0.1, "max_iterations": 20},
    "BOOSTED_TREE_CLASSIFIER": {"max_iterations": 50, "learn_rate": 0.1, "max_tree_depth": 6, "subsample": 0.85, "auto_class_weights": True},
    "BOOSTED_TREE_REGRESSOR": {"max_iterations": 50, "learn_rate": 0.1, "max_tree_depth": 6, "subsample": 0.85},
    "RANDOM_FOREST_CLASSIFIER": {"num_parallel_tree": 100, "max_tree_depth": 10, "subsample": 0.8},
    "RANDOM_FOREST_REGRESSOR": {"num_parallel_tree": 100, "max_tree_depth": 10, "subsample": 0.8},
    "DNN_CLASSIFIER": {"hidden_units": [256, 64], "learn_rate": 0.001, "max_iterations": 30, "batch_size": 64},
    "KMEANS": {"num_clusters": 12, "distance_type": "COSINE"},
    "PCA": {"num_principal_components": 32},
    "AUTOENCODER": {"hidden_units": [128, 32, 128]},
    "ARIMA_PLUS": {"data_frequency": "YEARLY", "auto_arima": True, "holiday_region": "NONE", "horizon": 3},
    "ARIMA_PLUS_XREG": {"data_frequency": "YEARLY", "auto_arima": True, "horizon": 3},
}
# What each model of Spark reads; another setting is refused instead of being ignored. Searches may vary all of them but the last row's.
READS = {
    "LOGISTIC_REG": {"l1_reg", "l2_reg", "max_iterations", "auto_class_weights"},
    "LINEAR_REG": {"l1_reg", "l2_reg", "max_iterations"},
    "BOOSTED_TREE_CLASSIFIER": {"max_iterations", "learn_rate", "max_tree_depth", "subsample", "min_split_loss", "auto_class_weights"},
    "BOOSTED_TREE_REGRESSOR": {"max_iterations", "learn_rate", "max_tree_depth", "subsample", "min_split_loss"},
    "RANDOM_FOREST_CLASSIFIER": {"num_parallel_tree", "max_tree_depth", "subsample", "min_split_loss", "auto_class_weights"},
    "RANDOM_FOREST_REGRESSOR": {"num_parallel_tree", "max_tree_depth", "subsample", "min_split_loss"},
    "DNN_CLASSIFIER": {"hidden_units", "max_iterations", "batch_size"},
    "KMEANS": {"num_clusters", "distance_type"},
    "PCA": {"num_principal_components"},
    "AUTOENCODER": {"hidden_units"},
    "ARIMA_PLUS": {"data_frequency", "auto_arima", "holiday_region", "horizon", "non_seasonal_order"},
    "ARIMA_PLUS_XREG": {"data_frequency", "auto_arima", "horizon", "non_seasonal_order"},
}
NOT_SEARCHED = {"max_iterations", "auto_class_weights", "distance_type", "num_principal_components", *READS["ARIMA_PLUS"]}
GATES: dict[str, dict[str, float]] = {
    "classification": {"recall": 0.85, "roc_auc": 0.85},
    "regression": {"r2_score": 0.5},
    "clustering": {"davies_bouldin_index_max": 1.5},
    "dimensionality_reduction": {"total_explained_variance_ratio": 0.7},
    "anomaly_detection": {},
    "time_series": {},
}


@dataclass(frozen=True)
class Examples:
    """Where a model's rows come from: feature columns (None: every number and vector but the others named), label and split columns."""

    features: tuple[str, ...] | None = ("embedding",)
    label: str = "label"
    split: str = "split"
    leave_out: tuple[str, ...] = ()

    def columns(self, data: DataFrame) -> list[str]:
        if self.features is not None:
            return list(self.features)
        apart = {self.label, self.split, *self.leave_out}
        usable = ("int", "bigint", "double", "float", "smallint", "tinyint", "array<double>", "array<float>")
        return [c for c, kind in data.dtypes if kind in usable and c not in apart]


@dataclass(frozen=True)
class Candidates:
    """Values to try per setting, and how many combinations: a grid, or proposed in rounds by the densities of good and other trials."""

    values: dict[str, list[Any]]
    trials: int
    by: str = "grid"
    at_once: int = 4


@dataclass(frozen=True)
class Recipe:
    """What to fit: a kind of learning, a model of it with settings, on which examples, and the bounds its metrics must keep."""

    kind: str
    model: str
    examples: Examples = Examples()
    settings: dict[str, Any] = field(default_factory=dict)
    candidates: Candidates | None = None
    bounds: dict[str, float] = field(default_factory=dict)
    seed: int = 7
    series: arima.Series | None = None

    def problems(self) -> list[str]:
        """All that is wrong with it, in words."""
        out = []
        if self.model not in MODEL_TYPES.get(self.kind, ()):
            out.append(f"no {self.kind} by {self.model}")
        reads = READS.get(self.model, set())
        out += [f"{self.model} has no setting {k}" for k in sorted(set(self.settings) - reads)]
        if self.candidates:
            out += [f"no search by {self.candidates.by}"] if self.candidates.by not in ("grid", "density") else []
            out += [f"{k} can't be searched for {self.model}" for k in sorted(set(self.candidates.values) - (reads - NOT_SEARCHED))]
        if self.labelled and not self.examples.label:
            out.append(f"{self.kind} needs a label column")
        if self.kind == "time_series":
            out += self.series_problems()
        return out

    def series_problems(self) -> list[str]:
        s, out = self.settings, []
        if self.series is None or not self.series.time or not self.series.value:
            return ["time_series needs a time and a value column"]
        if s.get("data_frequency", "YEARLY") not in arima.FREQUENCIES:
            out.append(f"data_frequency is one of {', '.join(arima.FREQUENCIES)}")
        if s.get("holiday_region", "NONE") != "NONE":
            out.append("holidays are not modelled")
        if s.get("auto_arima", True) == ("non_seasonal_order" in s):
            out.append("an order is given exactly when auto_arima is off")
        if bool(self.series.drivers) != (self.model == "ARIMA_PLUS_XREG"):
            out.append("drivers and ARIMA_PLUS_XREG go together")
        return out

    @property
    def labelled(self) -> bool:
        return self.kind in ("classification", "regression")

    def complete(self) -> dict[str, Any]:
        return DEFAULTS[self.model] | self.settings


def weak_labels(corpus: DataFrame, pattern: str, origin: str = "keywords") -> DataFrame:
    """A keyword label over the whole title and text, with a stable one-in-five test split and where the label comes from."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    return corpus.select("doc_id", holdout_of(F.col("doc_id")).alias("split"), text.rlike(pattern).cast("int").alias("label"), F.lit(origin).alias("label_origin"))


def training_rows(
    data: DataFrame, recipe: Recipe, part: str | None = "train", gold: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Features, and where a label is learned also it, of one split; labels of a gold table (row_id, label) replace the column's.

    Of a table of series: time, value, key and drivers, of all rows.

    Rows without a label are left out only when the label is a column of the data.
    """
    if recipe.kind == "time_series":
        return data.select(*keep, *recipe.series.columns())
    source = recipe.examples
    cols = [*keep, *source.columns(data)]
    if not recipe.labelled:
        return data.select(*cols)
    own = data.filter(F.col(source.split) == part) if source.split and part else data
    if gold is not None:
        return own.drop("label").join(gold.select("row_id", "label"), "row_id").select(*cols, "label")
    return own.filter(F.col(source.label).isNotNull()).select(*cols, F.col(source.label).alias("label"))


def features(df: DataFrame, cols: list[str]) -> DataFrame:
    """One vector column `features` from arrays and numbers."""
    kinds = dict(df.dtypes)
    parts = []
    for c in cols:
        if kinds[c].startswith("array"):
            df = df.withColumn(f"_{c}", array_to_vector(as_double(c)))
            parts.append(f"_{c}")
        else:
            parts.append(c)
    if len(parts) == 1 and parts[0].startswith("_"):
        return df.withColumnRenamed(parts[0], "features")
    return VectorAssembler(inputCols=parts, outputCol="features").transform(df).drop(*[p for p in parts if p.startswith("_")])


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (classes * n_class), joined from a row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg((F.sum("_n") / F.count(F.lit(1))).alias("w")).scalar()
    return df.join(counts, label).withColumn("weight", total / F.col("_n")).drop("_n")


def estimator(model_type: str, s: dict[str, Any], *, seed: int = 7, classes: int = 2, dim: int = 0, weighted: bool = False):
    """The Spark ML estimator for a model type and its settings."""
    w = {"weightCol": "weight"} if weighted else {}
    reg = s.get("l1_reg", 0.0) + s.get("l2_reg", 0.0)
    mix = {"regParam": reg, "elasticNetParam": s.get("l1_reg", 0.0) / reg if reg else 0.0}
    trees = {"maxDepth": s.get("max_tree_depth", 5), "subsamplingRate": s.get("subsample", 1.0), "minInfoGain": s.get("min_split_loss", 0.0), "seed": seed}
    if model_type == "LOGISTIC_REG":
        return mc.LogisticRegression(maxIter=s["max_iterations"], **mix, **w)
    if model_type == "LINEAR_REG":
        return mr.LinearRegression(maxIter=s["max_iterations"], **mix)
    if model_type == "BOOSTED_TREE_CLASSIFIER":
        one = mc.GBTClassifier(maxIter=s["max_iterations"], stepSize=s["learn_rate"], **trees, **w)
        return one if classes == 2 else mc.OneVsRest(classifier=one, parallelism=4, **w)
    if model_type == "BOOSTED_TREE_REGRESSOR":
        return mr.GBTRegressor(maxIter=s["max_iterations"], stepSize=s["learn_rate"], **trees)
    if model_type == "RANDOM_FOREST_CLASSIFIER":
        return mc.RandomForestClassifier(numTrees=s["num_parallel_tree"], **trees, **w)
    if model_type == "RANDOM_FOREST_REGRESSOR":
        return mr.RandomForestRegressor(numTrees=s["num_parallel_tree"], **trees)
    if model_type == "DNN_CLASSIFIER":
        return mc.MultilayerPerceptronClassifier(layers=[dim, *s["hidden_units"], classes], maxIter=s["max_iterations"], blockSize=s["batch_size"], seed=seed)
    if model_type == "KMEANS":
        return KMeans(k=s["num_clusters"], distanceMeasure=s["distance_type"].lower(), initMode="k-means||", seed=seed)
    if model_type == "PCA":
        return PCA(k=s["num_principal_components"], inputCol="features", outputCol="reduced")
    if model_type == "AUTOENCODER":
        return PCA(k=min(s["hidden_units"]), inputCol="features", outputCol="reduced")
    raise ValueError(f"no Spark model for {model_type}")


def p_positive(pred: DataFrame, out: str = "p_relevant") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def binary_metrics(scored: DataFrame, p: str = "p_relevant", threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1_score, roc_auc of a score column against a 0/1 label, in one row.

    The area counts, for each distinct score, the negatives below it: an aggregate by score and a
    running sum over the score order, so it is exact with ties and needs no single-task sort.
    """
    hit, pos = F.col(p) >= threshold, F.col("label") == 1
    per = scored.groupBy(F.col(p).alias("s")).agg(
        F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"),
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
    )
    o = global_order(per, "s", "s", sums=("pos", "neg", "tp", "fp"))
    below = F.col("neg_total") - F.col("neg_running")
    area = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    m = o.agg(area.alias("area"), *[F.max(f"{c}_total").alias(c) for c in ("pos", "neg", "tp", "fp")])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "pos")
    return m.select(
        precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1_score"),
        F.try_divide("area", F.col("pos").cast("double") * F.col("neg")).alias("roc_auc"),
    )


def classification_metrics(pred: DataFrame, classes: int) -> dict[str, float]:
    """Metrics of predictions from one count per (label, prediction); the area of two classes from one pass over the scores."""
    cells = {(r["label"], r["prediction"]): r["n"] for r in pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(cells.values())
    share: dict[float, list[float]] = {}
    for c in {label for label, _ in cells}:
        hit, said, is_ = cells.get((c, c), 0), sum(n for (_, p), n in cells.items() if p == c), sum(n for (y, _), n in cells.items() if y == c)
        p, r = hit / said if said else 0.0, hit / is_ if is_ else 0.0
        share[c] = [p, r, 2 * p * r / (p + r) if p + r else 0.0, is_]
    if classes > 2:
        mean = [sum(v[k] * v[3] for v in share.values()) / total if total else 0.0 for k in range(3)]
        return dict(zip(("precision", "recall", "f1_score"), mean)) | {"accuracy": sum(n for (y, p), n in cells.items() if y == p) / total if total else 0.0}
    p, r, f1, _ = share.get(1.0, [0.0] * 4)
    raw = "rawPrediction" if "rawPrediction" in pred.columns else "prediction"
    return {"precision": p, "recall": r, "f1_score": f1, "roc_auc": BinaryClassificationEvaluator(rawPredictionCol=raw).evaluate(pred)}


def regression_metrics(pred: DataFrame) -> dict[str, float]:
    off = F.col("label") - F.col("prediction")
    m = pred.agg(F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("mse"), F.var_pop("label").alias("var")).head()
    r2 = 1 - m["mse"] / m["var"] if m["var"] else 0.0
    return {"r2_score": r2, "mean_absolute_error": m["mae"] or 0.0, "mean_squared_error": m["mse"] or 0.0}


def kmeans_centroids(model, spark: SparkSession) -> DataFrame:
    """cluster_id (from 1) and centroid; k rows."""
    return spark.createDataFrame([(i + 1, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id bigint, centroid array<double>")


def fit_kmeans(vectors: DataFrame, k: int = 14, seed: int = 7) -> DataFrame:
    """Cosine k-means over (doc_id, embedding); returns the centroids."""
    model = estimator("KMEANS", {"num_clusters": k, "distance_type": "COSINE"}, seed=seed).fit(features(vectors, ["embedding"]))
    return kmeans_centroids(model, vectors.sparkSession)


def reconstruction_error(df: DataFrame, means: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Squared distance between a vector and its image in the principal subspace (`reduced`) around the mean of the vectors.

    `means` of `features` and `reduced` are those of `df` unless given.
    """
    if means is None:
        m = df.agg(Summarizer.mean(F.col("features")).alias("x"), Summarizer.mean(F.col("reduced")).alias("r")).head()
        means = [float(v) for v in m["x"].toArray()], [float(v) for v in m["r"].toArray()]

    def square(column, mean):
        return F.aggregate(F.zip_with(vector_to_array(column), F.lit(mean), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)

    # the components are orthonormal, so the lost part is what the projection does not keep
    return df.withColumn("anomaly", F.greatest(F.lit(0.0), square("features", means[0]) - square("reduced", means[1])))


def anomalies(df: DataFrame, score: str = "anomaly", share: float = 0.02) -> DataFrame:
    """Flags the most unusual `share` of rows, by an approximate quantile of the score."""
    cut = df.agg(F.percentile_approx(score, 1 - share, 10000)).scalar()
    return df.withColumn("is_anomaly", F.col(score) > cut)


@dataclass
class Trained:
    #: of series: a table with one model per row
    model: PipelineModel | DataFrame
    metrics: dict[str, float]
    passed: bool | None
    trials: list[tuple[dict[str, Any], float]]
    labels: list[str] | None = None


def grid(search: dict[str, list[Any]], trials: int) -> list[dict[str, Any]]:
    """Settings to try. Two numbers are a range, cut into even steps, or even ratios when the ends
    are a decade or more apart; anything else is a list of candidates."""
    axes = {}
    steps = max(2, round(trials ** (1 / max(1, len(search)))))
    for name, given in search.items():
        if len(given) == 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in given):
            lo, hi = given
            wide = lo > 0 and hi / lo >= 10
            at = [i / (steps - 1) for i in range(steps)]
            values = [lo * (hi / lo) ** t if wide else lo + (hi - lo) * t for t in at]
            axes[name] = sorted({round(v) for v in values}) if all(isinstance(v, int) for v in given) else values
        else:
            axes[name] = given
    return _spread([dict(zip(axes, combo)) for combo in product(*axes.values())], max(1, trials))


def _spread(settings: list[dict], most: int) -> list[dict]:
    """`most` of the settings, in their order: each next one has the most values not tried yet, a hash deciding between equals."""
    if len(settings) <= most:
        return settings
    tried: set[tuple[str, str]] = set()
    values = [{(k, repr(v)) for k, v in s.items()} for s in settings]
    left = sorted(range(len(settings)), key=lambda i: hashlib.sha256(repr(settings[i]).encode()).hexdigest())
    picked = []
    for _ in range(most):
        best = max(left, key=lambda i: len(values[i] - tried))
        left.remove(best)
        tried |= values[best]
        picked.append(best)
    return [settings[i] for i in sorted(picked)]


def train(data: DataFrame, recipe: Recipe, gold: DataFrame | None = None) -> Trained:
    """Fit on the train split, evaluate on the test split, and hold the metrics against the bounds.

    Class labels that are text are numbered by frequency in the train split; the model then also gives `predicted_label`.
    """
    if problems := recipe.problems():
        raise ValueError("; ".join(problems))
    if recipe.kind == "time_series":
        return train_series(data, recipe)
    columns = recipe.examples.columns(data)
    rows = features(training_rows(data, recipe, "train", gold), columns)
    names: list[str] | None = None
    shape: dict[str, Any] = {"classes": 2, "dim": 0, "weighted": False}
    if recipe.kind == "classification":
        if dict(rows.dtypes)["label"] == "string":
            names = StringIndexer(inputCol="label", outputCol="_n", stringOrderType="frequencyDesc").fit(rows).labels
        rows = numbered(rows, names)
        seen = rows.agg(F.max("label").alias("c"), F.first(F.size(vector_to_array("features"))).alias("d")).head()
        if seen["c"] is None:
            raise ValueError("no labelled rows to train on")
        shape |= {"classes": max(2, int(seen["c"]) + 1), "dim": seen["d"], "weighted": bool(recipe.complete().get("auto_class_weights"))}
        rows = balanced(rows) if shape["weighted"] else rows
    settings, trials = recipe.complete(), []
    if recipe.candidates and recipe.candidates.trials:
        trials, best = search(rows, recipe, shape)
        settings |= best
    fitted = estimator(recipe.model, settings, seed=recipe.seed, **shape).fit(rows)
    stages = [fitted] if names is None else [fitted, IndexToString(inputCol="prediction", outputCol="predicted_label", labels=names)]
    model = PipelineModel(stages=stages)
    metrics = evaluate(data, recipe, model, shape["classes"], gold, names)
    spark = data.sparkSession
    report = spark.createDataFrame([(json.dumps(metrics),)], "metrics_json string")
    passed = registry.check_gates(report, GATES[recipe.kind] | recipe.bounds).head()["passed"]
    return Trained(model, metrics, passed, trials, names)


def series_order(recipe: Recipe) -> tuple[int, int, int] | None:
    s = recipe.complete()
    return None if s["auto_arima"] else tuple(s["non_seasonal_order"])


def train_series(data: DataFrame, recipe: Recipe) -> Trained:
    """A model per series, written to the shared folder so that it is fitted once. Metrics: what the fits say of themselves (means over the series), and
    how well models of all but the last periods forecast those, as many as the horizon."""
    s, rows = recipe.complete(), training_rows(data, recipe)
    spark = data.sparkSession
    fitted = arima.fit(rows, recipe.series, s["data_frequency"], series_order(recipe))
    path = new_path(spark, "series-models")
    fitted.write.parquet(path)
    models = spark.read.schema(fitted.schema).parquet(path)
    own = arima.residual_report(models).agg(F.count(F.lit(1)).alias("n_series"), *[F.avg(c).alias(c) for c in ("aic", "log_likelihood", "variance")]).head().asDict()
    tested = arima.backtest(rows, recipe.series, s["horizon"], frequency=s["data_frequency"], order=series_order(recipe)).head().asDict()
    metrics = {k: float(v) for k, v in {**own, **tested}.items() if v is not None}
    report = spark.createDataFrame([(json.dumps(metrics),)], "metrics_json string")
    passed = registry.check_gates(report, GATES[recipe.kind] | recipe.bounds).head()["passed"]
    return Trained(models, metrics, passed, [])


def series_forecast(models: DataFrame, recipe: Recipe, confidence: float = 0.8, future: DataFrame | None = None) -> DataFrame:
    """Forecasts of a recipe's models over its horizon."""
    s = recipe.complete()
    return arima.forecast(models, s["horizon"], confidence, s["data_frequency"], future, recipe.series)


def numbered(rows: DataFrame, names: list[str] | None) -> DataFrame:
    """Labels as numbers; rows with a text label that the train split lacks are left out."""
    if names is None:
        return rows.withColumn("label", F.col("label").cast("double"))
    place = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("label"))
    return rows.withColumn("label", F.when(place > 0, (place - 1).cast("double"))).filter(F.col("label").isNotNull())


def evaluate(
    data: DataFrame, recipe: Recipe, model: PipelineModel, classes: int = 2, gold: DataFrame | None = None, names: list[str] | None = None
) -> dict[str, float]:
    """Metrics of a fitted model, on the test split where labels are learned."""
    fitted = model.stages[0]
    if recipe.labelled:
        test = features(training_rows(data, recipe, "test", gold), recipe.examples.columns(data))
        pred = model.transform(numbered(test, names))
        return classification_metrics(pred, classes) if recipe.kind == "classification" else regression_metrics(pred)
    if recipe.model == "KMEANS":
        c = kmeans_centroids(fitted, data.sparkSession)
        own = data.select("doc_id", F.col(recipe.examples.columns(data)[0]).alias("embedding"))
        q = vector.cluster_quality(vector.assign(own, c), c).head()
        return {"davies_bouldin_index": q["davies_bouldin_index"], "mean_squared_distance": q["mean_squared_distance"]}
    return {"total_explained_variance_ratio": float(sum(fitted.explainedVariance))}


def run_rows(spark: SparkSession, recipe: Recipe, trained: Trained, run_id: str, task: str, artifact: str, started_at, ended_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a run appends to the registry: a run, a model and an evaluation row."""
    model_id = f"m-{run_id}"
    spec = json.dumps({"kind": recipe.kind, "model": recipe.model, "settings": recipe.complete(), "bounds": recipe.bounds}, sort_keys=True)
    run = spark.createDataFrame([(run_id, recipe.kind, "succeeded", spec, started_at, ended_at)],
                                "run_id string, learning_type string, status string, config_json string, started_at timestamp, ended_at timestamp")
    model = spark.createDataFrame([(model_id, run_id, task, recipe.kind, artifact, ended_at)],
                                  "model_id string, run_id string, task string, learning_type string, artifact string, created_at timestamp")
    scores = spark.createDataFrame([(f"e-{run_id}", model_id, json.dumps(trained.metrics, sort_keys=True), ended_at)],
                                   "eval_id string, model_id string, metrics_json string, evaluated_at timestamp")
    return run, model, scores


def search(rows: DataFrame, recipe: Recipe, shape: dict[str, Any]) -> tuple[list, dict[str, Any]]:
    """Objective per setting on a held-out quarter, and the best setting."""
    asked = recipe.candidates
    if recipe.kind == "classification":
        ev = BinaryClassificationEvaluator() if shape["classes"] == 2 else MulticlassClassificationEvaluator(metricName="f1")
    elif recipe.kind == "regression":
        ev = RegressionEvaluator(metricName="r2")
    else:
        ev = ClusteringEvaluator(distanceMeasure=recipe.complete().get("distance_type", "COSINE").lower())
    given = recipe.complete()
    base = estimator(recipe.model, given, seed=recipe.seed, **shape)

    def measured(settings: list[dict[str, Any]]) -> list[tuple[dict[str, Any], float]]:
        maps = []
        for s in settings:
            tuned = estimator(recipe.model, {**given, **s}, seed=recipe.seed, **shape)
            maps.append({base.getParam(p.name): v for p, v in tuned.extractParamMap().items() if tuned.isSet(p)})
        tvs = TrainValidationSplit(estimator=base, estimatorParamMaps=maps, evaluator=ev, trainRatio=0.75, parallelism=asked.at_once, seed=recipe.seed)
        return list(zip(settings, tvs.fit(rows).validationMetrics))

    if asked.by == "grid":
        results = measured(grid(asked.values, asked.trials))
    else:
        results = []
        while len(results) < asked.trials:
            n = min(asked.at_once, asked.trials - len(results))
            settings = suggest.propose(asked.values, results, n, larger=ev.isLargerBetter(), start=max(asked.at_once, asked.trials // 3), seed=recipe.seed)
            if not settings:
                break
            results += measured(settings)
    pick = max if ev.isLargerBetter() else min
    return results, pick(results, key=lambda r: r[1])[0]


def explain(model: PipelineModel, rows: DataFrame, top: int = 20) -> DataFrame:
    """The `top` features by importance, or by |coefficient| times the feature's deviation."""
    fitted = model.stages[0]
    if hasattr(fitted, "featureImportances"):
        weight = fitted.featureImportances.toArray()
    else:
        sd = rows.agg(Summarizer.std(F.col("features")).alias("sd")).head()["sd"].toArray()
        coef = fitted.coefficientMatrix.toArray() if hasattr(fitted, "coefficientMatrix") else [fitted.coefficients.toArray()]
        weight = abs(sum(abs(c) for c in coef) / len(coef)) * sd
    ranked = sorted(enumerate(weight), key=lambda x: (-x[1], x[0]))[:top]
    return rows.sparkSession.createDataFrame([(int(i), float(w)) for i, w in ranked], "feature int, attribution double")


def text_embedder(dim: int = 768) -> Pipeline:
    """A text embedding that needs no hosted model: hashed tf-idf, unit length."""
    return Pipeline(stages=[
        Tokenizer(inputCol="content", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=1),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ])


def fit_embedder(df: DataFrame, content: str, dim: int = 768) -> PipelineModel:
    return text_embedder(dim).fit(df.select(F.col(content).alias("content")))


def embedded(model: PipelineModel, df: DataFrame, key: str, content: str) -> DataFrame:
    """key, embedding: vectors that can be compared with all others of the same model; texts without a known word get none."""
    out = model.transform(df.select(key, F.col(content).alias("content"))).select(key, vector_to_array("_unit").alias("embedding"))
    return out.filter(F.exists("embedding", lambda v: v != 0))


def sparse_embedded(model: PipelineModel, df: DataFrame, key: str, content: str) -> DataFrame:
    """As embedded(), but with Spark ML vectors, which hold no zeros; a text without a known word has an empty one."""
    return model.transform(df.select(key, F.col(content).alias("content"))).select(key, F.col("_unit").alias("embedding"))


def embed_text(df: DataFrame, key: str, content: str, dim: int = 768) -> DataFrame:
    rows = df.select(key, F.col(content).alias("content"))
    return text_embedder(dim).fit(rows).transform(rows).select(key, vector_to_array("_unit").alias("embedding"))
