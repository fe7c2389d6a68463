import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmap.operators import evidence, generate, vector

R = np.random.default_rng(5)
BASE, ASK = R.normal(size=(300, 6)).astype("float32"), R.normal(size=(7, 6)).astype("float32")
BASE[10] = BASE[20]  # a copy: ties go to the smaller id


def frame(spark, m, prefix):
    return spark.createDataFrame([(f"{prefix}{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, vec array<float>").repartition(3)


def brute(k):
    a, b = (m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True) for m in (ASK, BASE))
    d = np.round(1 - a @ b.T, 9)
    out = []
    for i in range(len(a)):
        order = sorted(range(len(b)), key=lambda j: (d[i, j], j))[:k]
        out += [(f"q{i:03d}", f"b{j:03d}", n + 1) for n, j in enumerate(order)]
    return sorted(out)


def taken(df):
    return sorted((r.a_id, r.b_id, r.rn) for r in df.collect())


def test_few_queries(spark):
    assert taken(vector.nearest(frame(spark, ASK, "q"), frame(spark, BASE, "b"), 5)) == brute(5)


def test_few_base_rows(spark):
    base = frame(spark, BASE, "b")
    few = vector._small(base, 1 << 20)
    found = vector._search_into_few(frame(spark, ASK, "q"), few, "string", 5)
    want = {(a, b) for a, b, _ in brute(5)}
    assert {(r.a_id, r.b_id) for r in found.collect()} == want


@pytest.mark.parametrize("cell", [3, 64, 1000])
def test_two_large_sides(spark, cell):
    # nothing fits in 1 byte, so both sides are cut into a grid
    assert taken(vector.nearest(frame(spark, ASK, "q"), frame(spark, BASE, "b"), 5, max_bytes=1, cell_rows=cell)) == brute(5)


@pytest.mark.parametrize("search", ["few", "into_few", "cells"])
def test_a_task_holds_few_distances_at_once(spark, monkeypatch, search):
    # tasks run in other processes, so they are told by value what to hold and fail if they hold more
    whole = vector._distances

    def small(a, b):
        assert len(a) * len(b) <= 640, "too many distances at once"
        return whole(a, b)

    monkeypatch.setattr(vector, "TILE", 640)
    monkeypatch.setattr(vector, "OUT_ROWS", 12)
    monkeypatch.setattr(vector, "_distances", small)
    a, b = frame(spark, ASK, "q"), frame(spark, BASE, "b")
    if search == "few":
        assert taken(vector.nearest(a, b, 5)) == brute(5)
    elif search == "into_few":
        found = vector._search_into_few(a, vector._small(b, 1 << 20), "string", 5)
        assert {(r.a_id, r.b_id) for r in found.collect()} == {x[:2] for x in brute(5)}
    else:
        assert taken(vector.nearest(a, b, 5, max_bytes=1, cell_rows=1000)) == brute(5)


def test_more_neighbours_than_rows(spark):
    assert vector.nearest(frame(spark, ASK[:1], "q"), frame(spark, BASE[:3], "b"), 10).count() == 3


def test_region_filter_may_leave_fewer(spark):
    base = frame(spark, BASE, "b").select(F.col("id").alias("doc_id"), F.col("vec").alias("embedding"))
    corpus = base.select("doc_id", F.when(F.col("doc_id") < "b010", "Asia").otherwise("Europe").alias("region"))
    topics = spark.createDataFrame(
        [(i, r, [float(x) for x in ASK[i]]) for i, r in enumerate([None, "All", "Asia", "Polar Regions"])], "topic_id int, region_filter string, embedding array<double>"
    )
    n = {r.topic_id: r["count"] for r in vector.retrieve(topics, base, corpus, 4).groupBy("topic_id").count().collect()}
    assert n[0] == 4 and n[1] == 4 and n.get(2, 0) < 4 and 3 not in n


def test_approximate_search_is_exact_with_all_cells(spark):
    base = frame(spark, BASE, "b").select(F.col("id").alias("doc_id"), F.col("vec").alias("embedding"))
    cents = evidence.centroids(base.withColumn("cluster_id", F.substring("doc_id", 4, 1).cast("bigint")))
    celled = base.join(vector.assign(base, cents).select("doc_id", F.col("cluster_id").alias("cell")), "doc_id")
    topics = frame(spark, ASK, "q").select(F.col("id").alias("topic_id"), F.col("vec").alias("embedding"))
    found = vector.search_cells(topics, celled, cents, 5, probes=10)
    assert sorted((r.topic_id, r.doc_id, r.rn) for r in found.collect()) == brute(5)
    assert vector.search_cells(topics, celled, cents, 5, probes=2).count() <= 35


def test_davies_bouldin_matches_numpy(spark):
    v = frame(spark, BASE, "b").select(F.col("id").alias("doc_id"), F.col("vec").alias("embedding"), (F.crc32("id") % 4).alias("cluster_id"))
    cents = evidence.centroids(v)
    assigned = vector.assign(v, cents)
    c = {r.cluster_id: np.array(r.centroid) for r in cents.collect()}
    d = {}
    for r in assigned.collect():
        d.setdefault(r.cluster_id, []).append(r.dist_to_centroid)
    s = {k: np.mean(x) for k, x in d.items()}

    def apart(i, j):
        return 1 - c[i] @ c[j] / np.linalg.norm(c[i]) / np.linalg.norm(c[j])

    want = np.mean([max((s[i] + s[j]) / apart(i, j) for j in s if j != i) for i in s])
    got = vector.cluster_quality(assigned, cents).head()
    assert round(got.davies_bouldin_index, 6) == round(want, 6) and got.mean_squared_distance > 0


def test_synthesis_without_passages(spark):
    base = spark.createDataFrame([("b1", [1.0, 0.0], 1, "text")], "doc_id string, embedding array<double>, page int, content string")
    corpus = spark.createDataFrame([("b1", "Asia")], "doc_id string, region string")
    topics = spark.createDataFrame([(1, "t", "Europe", [1.0, 0.0]), (2, "u", None, [1.0, 0.0])], "topic_id int, topic string, region_filter string, embedding array<double>")
    got = {r.topic_id: r for r in generate.synthesise(topics, base, corpus, 2).collect()}
    assert (got[1].n_passages, got[2].n_passages) == (0, 1)
    assert all(r.synthesis is None and r.confidence_rationale == "insufficient evidence retrieved" for r in got.values())
    with pytest.raises(ValueError):
        generate.synthesise(topics, base, corpus, 21)


def test_chunks_of_texts_against_brute_force(spark):
    import numpy as np

    from siftmap.functions import text
    from siftmap.operators import generate, learning

    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeo" for c in "klmn"]
    docs = spark.createDataFrame([(str(k), " ".join(words[(k * 7 + j * j * (k % 5 + 1)) % len(words)] for j in range(60)), "AB"[k % 2]) for k in range(40)], "doc_id string, abstract string, region string")
    topics = spark.createDataFrame([(f"t{k}", " ".join(words[k * 5:k * 5 + 6]), "A" if k == 2 else None) for k in range(6)], "topic_id string, topic string, region_filter string")
    pieces = text.chunks(docs)
    model = learning.fit_embedder(pieces, "text", 256)
    vectors = lambda f, i, t: {r[i]: np.array(r.embedding, float) for r in learning.embedded(model, f, i, t).collect()}
    base, asked = vectors(pieces, "chunk_id", "text"), vectors(topics, "topic_id", "topic")
    region = {r.chunk_id: "AB"[int(r.doc_id) % 2] for r in pieces.collect()}
    want = set()
    for t, q in asked.items():
        near = sorted((round(1 - q @ v / np.sqrt((q @ q) * (v @ v)), 6), c) for c, v in base.items())[:9]
        want |= {(t, d, n) for n, (d, _) in enumerate([x for x in near if t != "t2" or region[x[1]] == "A"][:3], 1)}
    got = {(r.topic_id, round(r.distance, 6), r.rn) for r in generate.retrieve_chunks(topics, docs, 3, 3).collect()}
    assert len(got) > 12 and sorted(x[::2] for x in got) == sorted(x[::2] for x in want)
    assert all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(sorted(got, key=lambda x: (x[0], x[2])), sorted(want, key=lambda x: (x[0], x[2]))))


def test_topics_are_all_rows_divisible_by_100(spark):
    from siftmap.catalog.vectors import asked
    from siftmap.sources.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    assert sorted(r.topic_id for r in asked(d).collect()) == sorted(f"t{r.doc_id}" for r in d.corpus().collect() if int(r.doc_id) % 100 == 0)


def test_rows_that_are_too_far_are_not_compared_in_full(monkeypatch):
    """The k nearest of many batches, with ties, equal rows and rows without a direction, and few distances in double precision."""
    import numpy as np

    rng = np.random.default_rng(6)

    def unit_rows(n, most):
        m = np.zeros((n, 128))
        for row in m:
            row[rng.integers(0, 128, rng.integers(1, most))] = rng.random()
        return vector._unit(m)

    q, m = unit_rows(40, 9), unit_rows(6000, 20)
    q[3], m[50], m[700:760], m[4000] = np.nan, np.nan, m[20], np.nan
    ids = np.array([f"c{k * 7919 % 6000}" for k in range(6000)], dtype=object)
    compared = []
    distances = vector._distances
    monkeypatch.setattr(vector, "_distances", lambda a, b: compared.append(len(a) * len(b)) or distances(a, b))
    for dense in (False, True):
        base = vector._unit(rng.standard_normal(m.shape)) if dense else m
        best = vector._Best(len(q), 5)
        for at in range(0, 6000, 1500):
            best.add(np.arange(len(q)), q, ids[at:at + 1500], base[at:at + 1500])
        for i in range(len(q)):
            near = sorted((d, c) for d, c in zip(np.round(1 - base @ q[i], 9), ids) if d == d)[:5]
            if near:
                assert [c for _, c in near] == best.ids[i].tolist() and np.allclose([d for d, _ in near], best.dist[i])
    assert sum(compared) < 0.25 * 2 * len(q) * len(m)


def test_vectors_without_their_zeros(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    rows = [("a", Vectors.sparse(4, [0, 2], [1.0, 2.0])), ("b", Vectors.dense([0.0, 1.0, 0.0, 3.0])), ("c", Vectors.sparse(4, [], [])), ("d", None), ("e", Vectors.sparse(4, [3], [5.0]))]
    sparse = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.StringType()), T.StructField("vec", VectorUDT())]))
    base = spark.createDataFrame([(i, v.toArray().tolist()) for i, v in rows if i in "abe"], "id string, vec array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0, 1.0, 0.0]), ("r", [0.0, 0.0, 0.0, 1.0])], "id string, vec array<double>")
    want = sorted(map(tuple, vector.nearest(asked, base, 4).collect()))
    assert len(want) == 6
    for most in (vector.BROADCAST_BYTES, 32):
        assert sorted(map(tuple, vector.nearest(asked, sparse, 4, most, 2).collect())) == want
