import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmap.operators import learning as op
from siftmap.operators import suggest

SPACE = {"l2_reg": [1e-6, 100.0], "subsample": [0.1, 1.0], "max_tree_depth": [2, 12]}


def planted(s):
    return -((math.log10(s["l2_reg"]) + 2.7) / 4) ** 2 - (s["subsample"] - 0.37) ** 2 * 3 - ((s["max_tree_depth"] - 9) / 10) ** 2


def searched(space, objective, trials, seed, larger=True):
    seen = []
    while len(seen) < trials:
        new = suggest.propose(space, seen, min(4, trials - len(seen)), larger=larger, start=8, seed=seed)
        if not new:
            break
        seen += [(s, objective(s)) for s in new]
    return seen


def test_the_planted_optimum_with_fewer_fits_than_a_grid():
    on_grid = max(planted(s) for s in op.grid(SPACE, 125))
    found = [max(v for _, v in searched(SPACE, planted, 48, seed)) for seed in range(15)]
    assert np.median(found) > on_grid
    assert np.median(found) > np.median([max(planted(suggest._even([suggest.Axis(k, v) for k, v in SPACE.items()], 48 * seed + k)) for k in range(48)) for seed in range(15)])


def test_later_trials_are_better_and_small_objectives_can_be_sought():
    seen = searched(SPACE, lambda s: -planted(s), 40, 1, larger=False)
    assert np.median([v for _, v in seen[-16:]]) < np.median([v for _, v in seen[:8]]) / 2


def test_choices_are_learned():
    space = {"hidden_units": [[4], [8], [16], [32], [64]], "subsample": [0.0, 1.0]}
    seen = searched(space, lambda s: (s["hidden_units"] == [16]) - (s["subsample"] - 0.8) ** 2, 40, 3)
    assert sum(s["hidden_units"] == [16] for s, _ in seen[20:]) > 8
    assert {tuple(s["hidden_units"]) for s, _ in seen} == {(4,), (8,), (16,), (32,), (64,)}


def test_bounds_repeats_and_used_up_spaces():
    seen = searched(SPACE, planted, 30, 5)
    assert len({suggest._key(s) for s, _ in seen}) == 30
    assert all(1e-6 <= s["l2_reg"] <= 100 and 0.1 <= s["subsample"] <= 1 and s["max_tree_depth"] in range(2, 13) for s, _ in seen)
    assert sorted(s["max_tree_depth"] for s, _ in searched({"max_tree_depth": [2, 6]}, lambda s: 0.0, 20, 1)) == [2, 3, 4, 5, 6]
    assert [s for s, _ in searched({"l2_reg": [0.5, 0.5]}, lambda s: 0.0, 4, 1)] == [{"l2_reg": 0.5}]
    assert [s for s, _ in searched({"distance": ["a", "b"]}, lambda s: 0.0, 4, 1)] in ([{"distance": "a"}, {"distance": "b"}], [{"distance": "b"}, {"distance": "a"}])


def test_failed_fits_repel():
    seen = searched({"subsample": [0.0, 1.0]}, lambda s: math.nan if s["subsample"] < 0.5 else 1.0, 40, 2)
    assert sum(s["subsample"] >= 0.5 for s, _ in seen[12:]) > 18


def test_search_in_a_recipe(spark):
    rng = np.random.default_rng(6)
    rows = [(f"d{i}", [float(x) for x in v], float(v[0] + rng.normal()), "train" if i % 5 else "test") for i, v in enumerate(rng.normal(size=(150, 20)))]
    data = spark.createDataFrame(rows, "doc_id string, embedding array<double>, amount double, split string").withColumn("row_id", F.col("doc_id")).cache()

    def run(by, trials):
        c = op.Candidates({"l1_reg": [1e-4, 10.0]}, trials, by=by)
        return op.train(data, op.Recipe("regression", "LINEAR_REG", op.Examples(label="amount"), candidates=c))

    # R squared on the held-out quarter: as good as a grid of as many fits to a thousandth
    dense, grid = run("density", 10), run("grid", 10)
    assert len(dense.trials) == len(grid.trials) == 10 and max(v for _, v in dense.trials) >= max(v for _, v in grid.trials) - 1e-3
    assert run("density", 5).trials == run("density", 5).trials
    with pytest.raises(ValueError):
        run("luck", 3)
