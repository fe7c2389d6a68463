"""Shapley values of tree ensembles: how much each feature moved a row's prediction from the mean, exactly.

A tree is a sum over its leaves: a leaf answers if every feature on its path lies in an interval. A feature left out of a coalition lies there
with the share of training rows that took those branches. With z_j that share and o_j whether the row fits (0 or 1), a leaf of value v gives feature i

    v (o_i - z_i) * integral over t in [0, 1] of the product over the path's other features j of (z_j (1 - t) + o_j t),

since the integral of t^k (1 - t)^(d - 1 - k) is the weight of coalitions of k among d features. The product is a polynomial of degree d - 1, so
Gauss-Legendre points give the integral exactly, and no factor is 0 between the ends. Values of a row and the base add up to the prediction.

Only the trees are broadcast, whose size their number and depth bound; rows are scored where they are read and sums combined before the shuffle.

Defined cases: a row without a vector, or whose vector holds NaN or null, has no values and counts in no mean; without rows the report is empty;
repeated rows count each. A model of categorical splits is refused.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.session import new_path

#: Numbers held at once by a task's products.
CELLS = 1 << 21
ROWS = 256


class Leaves(NamedTuple):
    """Leaves whose paths have equally many features."""

    value: np.ndarray  # leaf
    feature: np.ndarray  # leaf, place on the path
    above: np.ndarray  # fits if above < x <= upto
    upto: np.ndarray
    share: np.ndarray


class Ensemble(NamedTuple):
    base: float
    groups: list[Leaves]
    n_features: int


def node_table(model, spark: SparkSession) -> DataFrame:
    """The nodes of all trees as Spark ML stores them: tree, id, left, right, feature, threshold, rows, prediction, stats."""
    path = new_path(spark, "trees")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    return saved.select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), (n["split"]["numCategories"] >= 0).alias("categorical"), n["rawCount"].alias("n_rows"),
        n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"))


def read(model, spark: SparkSession, target: int = 1) -> Ensemble:
    """The leaves of a fitted random forest or boosted trees.

    What is explained: a regressor's prediction, the margin of boosted classification, a forest's probability of class `target`.
    """
    trees: dict[int, dict[int, dict]] = {}
    for r in node_table(model, spark).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    weights = list(model.treeWeights)
    voting = hasattr(model, "numClasses") and type(model).__name__.startswith("RandomForest")
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    found: dict[int, list[tuple]] = {}
    base = 0.0
    for tree, nodes in trees.items():
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = nodes[at]
            if node["left"] < 0:
                value = node["stats"][target] / sum(node["stats"]) if voting else node["prediction"]
                value *= weights[tree]
                base += value * float(np.prod([s for _, _, s in path.values()]))
                found.setdefault(len(path), []).append((value, path))
                continue
            if node["categorical"]:
                raise ValueError("categorical splits can't be explained")
            for child, low, high in ((node["left"], -np.inf, node["threshold"]), (node["right"], node["threshold"], np.inf)):
                lo, hi, s = path.get(node["feature"], (-np.inf, np.inf, 1.0))
                todo.append((child, path | {node["feature"]: (max(lo, low), min(hi, high), s * nodes[child]["n_rows"] / node["n_rows"])}))
    groups = []
    for d, leaves in sorted(found.items()):
        if d:
            sides = np.array([list(p.values()) for _, p in leaves])
            groups.append(Leaves(np.array([v for v, _ in leaves]), np.array([list(p) for _, p in leaves]), sides[..., 0], sides[..., 1], sides[..., 2]))
    return Ensemble(base, groups, model.numFeatures)


def contributions(x: np.ndarray, model: Ensemble) -> np.ndarray:
    """row, feature: what each feature adds to the base."""
    out = np.zeros((len(x), model.n_features))
    for g in model.groups if len(x) else ():
        d = g.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        step = max(1, CELLS // (len(x) * d))
        for low in range(0, len(g.value), step):
            some = slice(low, low + step)
            feature, share = g.feature[some], g.share[some]
            seen = x[:, feature]
            fits = ((seen > g.above[some]) & (seen <= g.upto[some])).astype(np.float64)
            total = np.zeros_like(fits)
            for t, w in zip(points, weights):
                factor = share * (1 - t) + fits * t
                total += w * factor.prod(axis=2, keepdims=True) / factor
            total *= (fits - share) * g.value[some][:, None]
            order = np.argsort(feature.ravel(), kind="stable")
            own, heads = np.unique(feature.ravel()[order], return_index=True)
            out[:, own] += np.add.reduceat(total.reshape(len(x), -1)[:, order], heads, axis=1)
    return out


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows, and their vectors."""
    given = column.to_pylist()
    usable = [i for i, v in enumerate(given) if v is not None and len(v) == width and None not in v]
    x = np.array([given[i] for i in usable], np.float64).reshape(len(usable), width)
    whole = ~np.isnan(x).any(axis=1)
    return np.array(usable, np.int64)[whole], x[whole]


def _array(column: str):
    return F.when(F.col(column).isNotNull(), vector_to_array(column))



def values(model: Ensemble, rows: DataFrame, key: str, column: str = "features") -> DataFrame:
    """key, base and contributions (null for rows without a usable vector) of every row."""
    sent = rows.sparkSession.sparkContext.broadcast((model.base, [tuple(g) for g in model.groups], model.n_features))

    def run(batches):
        base, groups, width = sent.value
        own = Ensemble(base, [Leaves(*g) for g in groups], width)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.slice(low, ROWS)
                at, x = _matrix(part.column(1), width)
                found: list = [None] * len(part)
                for i, v in zip(at.tolist(), contributions(x, own).tolist()):
                    found[i] = v
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([base] * len(part), pa.float64()), pa.array(found, pa.list_(pa.float64()))], ["key", "base", "contributions"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), _array(column).alias("x")).mapInArrow(run, f"key {kind}, base double, contributions array<double>")
    return out.withColumnRenamed("key", key)


def mean_influence(model: Ensemble, rows: DataFrame, column: str = "features") -> DataFrame:
    """feature, attribution (mean absolute value), mean_value and n_rows, of all rows with a usable vector."""
    sent = rows.sparkSession.sparkContext.broadcast((model.base, [tuple(g) for g in model.groups], model.n_features))

    def run(batches):
        base, groups, width = sent.value
        own = Ensemble(base, [Leaves(*g) for g in groups], width)
        size, signed, n = np.zeros(width), np.zeros(width), 0
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                _, x = _matrix(batch.column(0).slice(low, ROWS), width)
                v = contributions(x, own)
                size += abs(v).sum(axis=0)
                signed += v.sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(range(width), pa.int32()), "size": pa.array(size), "signed": pa.array(signed), "n": pa.array([n] * width, pa.int64())})

    parts = rows.select(_array(column).alias("x")).mapInArrow(run, "feature int, size double, signed double, n bigint")
    n = F.sum("n")
    return parts.groupBy("feature").agg((F.sum("size") / n).alias("attribution"), (F.sum("signed") / n).alias("mean_value"), n.alias("n_rows"))
