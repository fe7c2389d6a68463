import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftmap.functions.hashing import content_hash, holdout_of, split_of
from siftmap.operators import datasets as op
from siftmap.sources import ndjson


def test_split_is_stable_disjoint_and_near_its_fractions(spark):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    first = ids.select("k", split_of(F.col("k")).alias("s"))
    again = ids.union(spark.createDataFrame([("new",)], "k string")).repartition(7).select("k", split_of(F.col("k")).alias("t"))
    assert first.join(again, "k").filter("s <> t").count() == 0
    share = {r.s: r["count"] / 20000 for r in first.groupBy("s").count().collect()}
    assert abs(share["train"] - 0.70) < 0.02 and abs(share["val"] - 0.15) < 0.02 and abs(share["test"] - 0.15) < 0.02
    assert abs(ids.filter(holdout_of(F.col("k")) == "test").count() / 20000 - 0.2) < 0.02


def test_hash_ignores_order_and_sees_changes(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("s"))
    one = content_hash(df).head()
    assert content_hash(df.orderBy(F.desc("id")).repartition(5)).head() == one
    assert content_hash(df.filter("id < 499")).head().content_hash != one.content_hash
    assert content_hash(df.union(df.limit(1))).head().content_hash != one.content_hash
    assert content_hash(df.limit(0)).head().n_rows == 0


def test_build_writes_a_version_once(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("row_id"), F.array(F.lit(1.0)).alias("embedding"))
    m = op.build(df, str(tmp_path), "d", 1, source="range").head()
    assert (m.n_rows, m.version, m.name) == (50, 1, "d")
    assert [c["name"] for c in json.loads(m.schema_json)] == ["row_id", "embedding", "split"]
    stored = spark.read.parquet(m.path + "/data")
    assert content_hash(stored).head().content_hash == m.content_hash and stored.count() == 50
    with pytest.raises(AnalysisException):
        op.build(df, str(tmp_path), "d", 1)
    assert op.build(df, str(tmp_path), "d", 2).head().content_hash == m.content_hash
    assert op.preview(stored, 3).columns == ["row_id", "split"] and op.preview(stored, 3).count() == 3


def test_empty_dataset_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        op.build(spark.range(0).select(F.col("id").cast("string").alias("row_id")), str(tmp_path), "none", 1)


def test_missing_row_ids_are_derived(spark, tmp_path):
    m = op.build(spark.range(3).select("id"), str(tmp_path), "r", 1, split=False).head()
    ids = {r.row_id for r in spark.read.parquet(m.path + "/data").collect()}
    assert len(ids) == 3 and m.split_fracs == "null"


def test_next_version(spark):
    d = spark.createDataFrame([("a", 1), ("a", 4)], "name string, version bigint")
    assert op.next_version(d, "a").head().v == 5 and op.next_version(d, "b").head().v == 1


def test_unlabelled_rows_stay_in_the_screening_recipe(spark, rows):
    c = spark.createDataFrame([("1", "t", "a", 2000, None, "en", "news"), ("2", "t", "a", 2000, None, "en", "news")], "doc_id string, title string, abstract string, year int, region string, language string, source_type string")
    e = spark.createDataFrame([("1", [1.0]), ("2", [1.0])], "doc_id string, embedding array<double>")
    v = spark.createDataFrame([("1", 0), ("1", 1)], "doc_id string, label int")
    assert rows(op.screening(c, e, v), "row_id", "label") == [("1", 1), ("2", None)]


def test_chat_lines(spark):
    df = spark.createDataFrame([("1", "hi", "x", "test"), ("2", None, "y", None), ("3", "z", None, "train")], "row_id string, title string, target string, split string")
    got = {r.row_id: r for r in op.chat_examples(df, ["title"], "target", "sys").collect()}
    assert set(got) == {"1", "2"} and got["1"].part == "validation" and got["2"].part == "train"
    line = json.loads(got["1"].value)
    assert line["contents"][0]["parts"][0]["text"] == "title: hi" and line["contents"][1] == {"role": "model", "parts": [{"text": "x"}]}
    assert json.loads(got["2"].value)["contents"][0]["parts"][0]["text"] == "title: "


def test_ndjson_keeps_nulls_and_unicode(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ("b", 1)], "a string, n int")
    ndjson.write(df, f"{tmp_path}/x")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/x").collect())
    assert lines == ['{"a":"b","n":1}', '{"a":"é","n":null}']
    assert ndjson.load(spark, f"{tmp_path}/x", "a string, n int", f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert ndjson.load(spark, f"{tmp_path}/missing", "a string", f"{tmp_path}/t2") is False
