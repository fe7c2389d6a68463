import json

import pytest
from pyspark.sql import functions as F

from siftmap.functions import jsontext, replies, text
from siftmap.operators import generate


def parsed(spark, *raws):
    df = spark.createDataFrame([(str(i), "d", r) for i, r in enumerate(raws)], "row_id string, doc_id string, raw string")
    return df


@pytest.mark.parametrize(
    "raw,valid",
    [
        ('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('```{"a": 1}```', True), ('[1, 2]', True), ('{"a": 1', False), ("no", False), ("", False),
        ('{"a": 1} tail', False),
    ],
)
def test_clean_json(spark, raw, valid):
    df = parsed(spark, raw)
    assert (df.select(jsontext.clean_json("raw").alias("j")).head().j is not None) == valid
    assert (jsontext.with_json(df).head().j is not None) == valid
    assert jsontext.with_json(df, drop_bad=True).count() == int(valid)


def test_missing_reply(spark):
    assert jsontext.with_json(parsed(spark, None)).head().j is None


@pytest.mark.parametrize(
    "value,got",
    [('"x"', "x"), ("1.0", "1.0"), ("true", "true"), ("null", None), ('{"b": 1}', None), ("[1]", None), ('"[d1 p.2] says"', "[d1 p.2] says"), ('"{odd"', "{odd")],
)
def test_only_scalars(spark, value, got):
    df = jsontext.with_json(parsed(spark, '{"k": %s}' % value))
    assert df.select(jsontext.scalar("j", "$.k").alias("v")).head().v == got
    assert jsontext.scalars(df, "j", ["k", "none"]).head().k == got


def test_opinions_keep_and_metadata_drops_what_does_not_parse(spark):
    df = parsed(spark, '{"decision": "include", "agrees_with_model": "maybe"}', "broken")
    got = {r.row_id: r for r in jsontext.second_opinion(df).collect()}
    assert got["0"].llm_decision == "include" and got["0"].agrees_with_model is None
    assert got["1"].llm_decision is None and not got["1"].parsed
    assert jsontext.metadata(df).count() == 1


def test_prelabels_outside_the_space_are_dropped(spark):
    df = parsed(spark, '{"label": "x", "confidence": 0.8}', '{"label": "q"}', '{"label": null}').withColumn("task_id", F.lit("t")).withColumn("label_space", F.lit('["x", "y"]'))
    one = jsontext.prelabels(df).collect()
    assert [(r.row_id, r.label, r.confidence) for r in one] == [("0", "x", 0.8)]
    assert jsontext.prelabels(df).head().label_id == one[0].label_id


def test_records(spark, rows):
    df = parsed(spark, '[{"action": "a", "effect_size": 0.5}, {"action": "b", "effect_size": "n/a"}]', "[]", "broken", '{"records": [{"action": "c"}]}')
    assert rows(jsontext.outcome_records(df), "row_id", "action", "effect_size")[:2] == [("0", "a", 0.5), ("0", "b", None)]
    assert {r.row_id for r in jsontext.outcome_records(df).filter("action IS NOT NULL").collect()} == {"0"}
    assert rows(jsontext.outcome_records(df, "$.records"), "row_id", "action") == [("3", "c")]


def test_prompt_survives_missing_fields(spark):
    df = spark.createDataFrame([(None, 0.25)], "title string, p double")
    assert df.select(text.prompt("Do it.", {"Title": "title", "P": "p"}, missing="?").alias("x")).head().x == "Do it.\n\nTitle: ?\nP: 0.25"


def test_citations(spark, rows):
    df = spark.createDataFrame([("t", "A [d1 p.2]. B [d x p.3] [gone p.10], [d1 p.2]")], "k string, body string")
    c = text.citations(df, "k", "body")
    assert [(r.cited_id, r.page) for r in c.orderBy("position").collect()] == [("d1", 2), ("gone", 10), ("d1", 2)]
    corpus = spark.createDataFrame([("d1", "T", 2000, None, "news")], "doc_id string, title string, year int, region string, source_type string")
    assert rows(text.resolve(c, corpus), "cited_id", "known") == [("d1", True), ("d1", True), ("gone", False)]
    p = text.citation_precision(c, corpus, spark.createDataFrame([("d1", "citation_ok")], "doc_id string, decision_type string")).head()
    assert (p.n_cited, round(p.known_share, 6), round(p.verified_share, 6)) == (3, 0.666667, 0.666667)


@pytest.mark.parametrize("body", ["One. Two. Three.", "  padded . . \n\t. x", "", ". . ", "é à. ça va.. end", "no stop", "a. " * 5000])
def test_chunks_point_back_into_the_text(spark, body):
    got = text.chunks(spark.createDataFrame([("d", body), ("e", None)], "doc_id string, abstract string")).orderBy("chunk_index").collect()
    pieces = body.split(". ")
    assert [r.chunk_index for r in got] == [i for i, p in enumerate(pieces) if p.strip(text.SPACE)]
    for r in got:
        assert body[r.char_start : r.char_end] == pieces[r.chunk_index]
        assert r.text == pieces[r.chunk_index].strip(text.SPACE).rstrip(".") + "." and r.page == 1 + r.chunk_index // 3


def test_passages_are_ordered(spark):
    hits = spark.createDataFrame([(1, "b", 2, "two", 0.2), (1, "a", 1, "one", 0.1)], "topic_id int, doc_id string, page int, content string, distance double")
    assert text.format_passages(hits).head().passages == "[a p.1] one\n[b p.2] two"


def test_generation_uses_the_given_callable_once_per_row(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("prompt"))
    out = generate.generate(df, "prompt", lambda prompts: [json.dumps({"n": len(p)}) for p in prompts], batch=3)
    assert {r.raw for r in out.collect()} == {'{"n": 1}'} and out.count() == 10


def test_rules_answer_in_the_shape_the_parsers_read(spark):
    docs = spark.createDataFrame([("1", "Floods in Asia", "text " * 40, 0.5, "Asia", "s", None)], "doc_id string, title string, abstract string, p_relevant double, region string, sector string, hazard string")
    assert generate.extract_metadata(docs).head().region == "Asia"
    assert generate.second_opinions(docs).head().llm_decision == "include"
    assert [r.action for r in generate.extract_outcomes(docs).collect()] == ["text"]  # the rule names a text's most frequent word
    titles = spark.createDataFrame([(1, "flood risk\nflood response", 2)], "cluster_id bigint, titles string, n_docs bigint")
    assert "flood" in generate.label_clusters(titles).head().label
    assert json.loads(replies.rule_based([text.SYNTHESIS + "\nonly [a p.1] one"])[0])["confidence_rationale"] == replies.INSUFFICIENT
