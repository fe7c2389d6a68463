import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siftmap.operators import learning, shapley

KINDS = ["RANDOM_FOREST_REGRESSOR", "BOOSTED_TREE_REGRESSOR", "RANDOM_FOREST_CLASSIFIER", "BOOSTED_TREE_CLASSIFIER"]
FEW = {"num_parallel_tree": 5, "max_iterations": 5, "learn_rate": 0.3, "max_tree_depth": 4, "subsample": 0.9}


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    rows = []
    for i, v in enumerate(r.normal(size=(300, 6)).round(1)):
        rows.append((i, Vectors.dense(v), float(2 * v[0] + v[1] * v[2] + (v[3] > 0)), float(v[0] + v[1] * v[2] > 0)))
    return spark.createDataFrame(rows, ["id", "features", "amount", "flag"]).cache()


@pytest.fixture(scope="module", params=KINDS)
def fitted(request, data):
    label = "flag" if request.param.endswith("CLASSIFIER") else "amount"
    return request.param, learning.estimator(request.param, FEW).fit(data.withColumn("label", F.col(label)))


def answered(kind, row):
    if kind == "RANDOM_FOREST_CLASSIFIER":
        return row["probability"][1]
    return row["rawPrediction"][1] if kind == "BOOSTED_TREE_CLASSIFIER" else row["prediction"]


def expected(nodes, x, known, at=0):
    """A tree's mean answer when only `known` features are: other splits are averaged by their training rows."""
    node = nodes[at]
    if node.left < 0:
        return node
    sides = nodes[node.left], nodes[node.right]
    if node.feature in known:
        return expected(nodes, x, known, node.left if x[node.feature] <= node.threshold else node.right)
    return [(s.n_rows / node.n_rows, expected(nodes, x, known, s.id)) for s in sides]


def total(found, value):
    return sum(w * total(f, value) for w, f in found) if isinstance(found, list) else value(found)


def test_values_add_up_to_the_prediction(spark, data, fitted):
    kind, model = fitted
    ensemble = shapley.read(model, spark)
    got = {r.id: r for r in shapley.values(ensemble, data, "id").collect()}
    rows = model.transform(data).collect()
    assert len(got) == len(rows) == 300
    for row in rows:
        assert got[row.id].base + sum(got[row.id].contributions) == pytest.approx(answered(kind, row), abs=1e-9)


def test_values_equal_enumeration_of_all_coalitions(spark, data, fitted):
    kind, model = fitted
    ensemble = shapley.read(model, spark)
    trees = {}
    for n in shapley.node_table(model, spark).collect():
        trees.setdefault(n.tree, {})[n.id] = n
    weights = np.array(model.treeWeights)
    if kind.startswith("RANDOM"):
        weights = weights / weights.sum()
    value = (lambda n: n.stats[1] / sum(n.stats)) if kind == "RANDOM_FOREST_CLASSIFIER" else (lambda n: n.prediction)
    x = np.array([r.features.toArray() for r in data.orderBy("id").limit(4).collect()])
    got = shapley.contributions(x, ensemble)
    for k, row in enumerate(x):
        worth = {s: sum(w * total(expected(trees[t], row, set(s)), value) for t, w in enumerate(weights)) for n in range(7) for s in combinations(range(6), n)}
        assert ensemble.base == pytest.approx(worth[()])
        for i in range(6):
            rest = [j for j in range(6) if j != i]
            want = sum(math.factorial(n) * math.factorial(5 - n) / math.factorial(6) * (worth[tuple(sorted((*s, i)))] - worth[s]) for n in range(6) for s in combinations(rest, n))
            assert got[k, i] == pytest.approx(want, abs=1e-9)


def test_report_is_the_mean_over_rows(spark, data, fitted):
    ensemble = shapley.read(fitted[1], spark)
    x = np.array([r.features.toArray() for r in data.collect()])
    v = shapley.contributions(x, ensemble)
    got = {r.feature: r for r in shapley.mean_influence(ensemble, data.repartition(5)).collect()}
    assert sorted(got) == list(range(6))
    for i in range(6):
        assert (got[i].attribution, got[i].mean_value, got[i].n_rows) == (pytest.approx(abs(v[:, i]).mean()), pytest.approx(v[:, i].mean(), abs=1e-9), 300)
    assert max(got, key=lambda i: got[i].attribution) in (0, 1, 2) and min(got, key=lambda i: got[i].attribution) in (3, 4, 5)


def test_rows_without_a_usable_vector(spark, data, fitted):
    ensemble = shapley.read(fitted[1], spark)
    odd = spark.createDataFrame([(1, None), (2, Vectors.dense([math.nan] * 6)), (3, Vectors.dense([0.0] * 6)), (3, Vectors.dense([0.0] * 6))], StructType([StructField("id", LongType()), StructField("features", VectorUDT())]))
    got = shapley.values(ensemble, odd, "id").orderBy("id").collect()
    assert [r.contributions is None for r in got] == [True, True, False, False]
    assert {r.n_rows for r in shapley.mean_influence(ensemble, odd).collect()} == {2}
    assert shapley.mean_influence(ensemble, odd.limit(0)).count() == 0
