import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmap.llm import learned_partitions as lp
from siftmap.llm.queries import QUERIES


def brute(ids, x, queries, k=5):
    out = {}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in queries:
        i = ids.index(q)
        s = unit @ unit[i]
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


def answers(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, key int")


@pytest.fixture
def points():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    x = np.float32(centre[rng.integers(0, 12, 700)] + 0.4 * rng.normal(size=(700, 16)))
    return list(range(700)), x


def test_all_parts_give_the_exact_answer(spark, points):
    ids, x = points
    x = np.concatenate([x, x[:20], np.repeat(x[50:51], 60, axis=0)])  # equal vectors, among them queries
    ids = list(range(len(x)))
    got = answers(lp.search(frame(spark, [(i, v.tolist()) for i, v in zip(ids, x)]), F.col("vec_id") % 50 == 0, probed=99, block=100))
    want = brute(ids, x.astype(float), [i for i in ids if i % 50 == 0])
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in near]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)


def test_recall_on_supplied_vectors(spark):
    base = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{base}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.tolist(), np.array(rows.embedding.tolist(), float)
    got, want = answers(QUERIES["op2_learned_partitions"](spark, base)), brute(ids, x, [i for i in ids if i % 50 == 0])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    assert hit / (5 * len(want)) >= 0.9


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (50, [])]
    got = answers(lp.search(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == {0: [(8, 1.0), (1, 0.0)]}


def test_few_and_no_rows(spark):
    assert answers(lp.search(frame(spark, [(0, [1.0, 1.0])]), F.col("vec_id") % 50 == 0)) == {}
    assert answers(lp.search(frame(spark, []), F.col("vec_id") % 50 == 0)) == {}
    assert answers(lp.search(frame(spark, [(1, [1.0, 1.0]), (2, [1.0, 0.0])]), F.col("vec_id") % 50 == 0)) == {}


def test_short_answers_search_all_parts(spark, points):
    ids, x = points
    got = answers(lp.search(frame(spark, [(i, v.tolist()) for i, v in zip(ids[:60], x)]), F.col("vec_id") % 50 == 0, k=55, parts=8, probed=1))
    assert {q: len(v) for q, v in got.items()} == {0: 55, 50: 55}


def test_parts_are_balanced_and_follow_the_graph(points):
    _, x = points
    a = lp.neighbour_graph(x.astype(float))
    part = lp.balanced_parts(a, 8)
    assert np.ptp(np.bincount(part, minlength=8)) <= 3
    assert a[part[:, None] == part[None, :]].sum() > 0.6 * a.sum()
