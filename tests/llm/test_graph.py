"""Tables written between steps: their results, and in how many files they come."""

import uuid
from pathlib import Path

import pytest

import corpus_pipeline
from siftmap.llm import graph


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Folders of stored tables, in a session that leaves every one of 32 shuffle partitions as it is."""
    monkeypatch.setattr(graph, "new_path", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield lambda: {p.name: len(list(p.glob("part-*"))) for p in Path(tmp_path).iterdir()}
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_of_a_small_graph_are_few_files(spark, written):
    edges = spark.range(1, 1500).selectExpr("id AS a", "id - 1 AS b").where("a % 300 != 0")
    got = {r.node: r.root for r in graph.components(edges, "a", "b", edges.count()).collect()}
    assert got == {k: k - k % 300 for k in range(1500)}
    assert len(written()) > 2 and max(written().values()) <= spark.sparkContext.defaultParallelism


def test_more_rows_take_more_partitions_but_none_are_added(spark):
    frame, cores = spark.range(0, 100, 1, 64), spark.sparkContext.defaultParallelism
    assert [graph.gathered(frame, n, 10).rdd.getNumPartitions() for n in (0, 100, 200, 10_000)] == [cores, max(cores, 10), 20, 64]
    assert sorted(r.id for r in graph.gathered(frame, 0).collect()) == list(range(100))


def test_stages_of_the_pipeline_write_few_files(spark, written):
    word = lambda k, i: "".join(chr(97 + int(c)) for c in f"{k % 200:03}{i:02}")  # noqa: E731  no digits: they would be variable fields
    texts = [" ".join(word(k, i) for i in range(12)) + "\nthe same line of quite a few words on all the pages" for k in range(400)]
    docs = graph.stored(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    for name, stage in (("line_dedup", corpus_pipeline.line_dedup), ("near_duplicates", corpus_pipeline.near_duplicates)):
        docs = graph.stored(stage(spark, docs, ""), name)
    # the line of all texts stays in the first one, which makes that differ from its copy
    assert sorted(r.doc_id for r in docs.collect()) == list(range(201))
    assert {"line_dedup", "near_duplicates", "members", "lines", "dropped"} <= {n.rpartition("-")[0] for n in written()}
    assert max(written().values()) <= spark.sparkContext.defaultParallelism
