"""Dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmap.catalog import query
from siftmap.catalog.oracle import bucket
from siftmap.functions.hashing import content_hash, holdout_of, split_of
from siftmap.operators import datasets as op
from siftmap.operators import labeling
from siftmap.operators.living import yearly
from siftmap.session import new_path
from siftmap.sources import ndjson

VEC = "round(list_sum(embedding::DOUBLE[]), 4) AS vec_sum"


def vec_sum(df):
    """The vector as one number, for comparison."""
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("vec_sum", F.round(total, 4)).drop("embedding")


def lang_split(key: str) -> str:
    return f"CASE WHEN {bucket(key)} % 100 < 70 THEN 'train' WHEN {bucket(key)} % 100 < 85 THEN 'val' ELSE 'test' END"


@query("dataset_recipe_screening", f"""SELECT c.doc_id AS row_id, c.title, c.abstract, c.year, c.region, c.language, c.source_type, {VEC}, v.label
FROM corpus c JOIN corpus_embeddings e ON e.doc_id = c.doc_id LEFT JOIN (SELECT doc_id, (avg(label) >= 0.5)::INTEGER AS label FROM screening_labels GROUP BY 1) v ON v.doc_id = c.doc_id""")
def _(d):
    return vec_sum(op.screening(d.corpus(), d.embeddings(), d.screening_labels()))


@query("dataset_recipe_evidence_type", f"SELECT c.doc_id AS row_id, title, abstract, region, sector, hazard, evidence_type AS label, {VEC} FROM corpus c JOIN corpus_embeddings e ON e.doc_id = c.doc_id WHERE evidence_type IS NOT NULL")
def _(d):
    return vec_sum(op.evidence_type(d.corpus(), d.embeddings()))


@query("dataset_recipe_credibility", f"SELECT c.doc_id AS row_id, source_type, language, year, n_pages, round(credibility_score, 6) AS label, {VEC} FROM corpus c JOIN corpus_embeddings e ON e.doc_id = c.doc_id WHERE credibility_score IS NOT NULL")
def _(d):
    return vec_sum(op.credibility(d.corpus(), d.embeddings())).withColumn("label", F.round("label", 6))


@query("dataset_recipe_unsupervised", f"SELECT doc_id AS row_id, {VEC} FROM corpus_embeddings")
def _(d):
    return vec_sum(op.unsupervised(d.embeddings()))


@query("dataset_recipe_cluster_ts", "SELECT cluster_id || '-' || yr AS row_id, cluster_id, yr, n_docs FROM cluster_yearly")
def _(d):
    return op.cluster_series(yearly(d.clusters(), d.corpus().select("doc_id", "year")))


@query("dataset_recipe_metadata_tuning", """SELECT doc_id AS row_id, title, abstract, json_object('region', region, 'country', country, 'sector', sector, 'hazard', hazard, 'evidence_type', evidence_type,
 'adaptation_type', adaptation_type, 'outcome_reported', outcome_reported, 'confidence_language', confidence_language)::VARCHAR AS target_json FROM corpus WHERE provenance = 'synthetic' AND evidence_type <> 'off_topic'""")
def _(d):
    return op.metadata_tuning(d.corpus())


@query("split_assign", f"SELECT doc_id AS row_id, {lang_split('doc_id')} AS split FROM corpus")
def _(d):
    return d.corpus().select(F.col("doc_id").alias("row_id"), split_of(F.col("doc_id")).alias("split"))


@query("split_hash_mod5", f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN {bucket('doc_id')} % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM corpus) GROUP BY 1")
def _(d):
    return d.corpus().groupBy(holdout_of(F.col("doc_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("content_hash", """SELECT count(*) AS n_rows, concat_ws('-', """ + ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::HUGEINT)::VARCHAR" for i in range(4)) + """) AS content_hash FROM (
 SELECT sha256(json_object('doc_id', doc_id, 'title', title, 'abstract', abstract, 'year', year, 'region', region)::VARCHAR) AS h FROM corpus)""")
def _(d):
    return content_hash(d.corpus().select("doc_id", "title", "abstract", "year", "region"))


@query("dataset_next_version", "SELECT coalesce(max(version), 0) + 1 AS v FROM datasets WHERE name = 'Brand#7'")
def _(d):
    return op.next_version(d.datasets(), "Brand#7")


@query("dataset_list", "SELECT dataset_id, name, version, n_rows, notes FROM datasets ORDER BY created_seq DESC")
def _(d):
    return d.datasets().orderBy(F.desc("created_seq")).select("dataset_id", "name", "version", "n_rows", "notes")


@query("dataset_get", "SELECT dataset_id, name, version, n_rows, notes FROM datasets WHERE dataset_id = 'ds_17'")
def _(d):
    return d.datasets().filter(F.col("dataset_id") == "ds_17").select("dataset_id", "name", "version", "n_rows", "notes")


@query("dataset_preview", "SELECT doc_id AS row_id, title, year FROM corpus WHERE doc_id IN (SELECT doc_id FROM corpus_embeddings) ORDER BY row_id LIMIT 20")
def _(d):
    rows = d.corpus().select(F.col("doc_id").alias("row_id"), "title", "year").join(op.unsupervised(d.embeddings()), "row_id")
    return op.preview(rows, 20)


TUNING = """SELECT doc_id AS row_id, title, abstract, json_object('region', region, 'country', country, 'sector', sector, 'hazard', hazard, 'evidence_type', evidence_type,
 'adaptation_type', adaptation_type, 'outcome_reported', outcome_reported, 'confidence_language', confidence_language)::VARCHAR AS target_json FROM corpus WHERE provenance = 'synthetic' AND evidence_type <> 'off_topic'"""
FOLD = "concat_ws('-', " + ", ".join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::HUGEINT)::VARCHAR" for i in range(4)) + ")"


@query("dataset_build", f"""SELECT 'tuning' AS name, 1::BIGINT AS version, count(*) AS n_rows, {FOLD} AS content_hash, '[0.7, 0.15, 0.15]' AS split_fracs, 'job' AS created_by FROM (
 SELECT sha256(json_object('row_id', row_id, 'title', title, 'abstract', abstract, 'target_json', target_json, 'split', {lang_split('row_id')})::VARCHAR) AS h FROM ({TUNING}))""")
def _(d):
    """A new version written with split and manifest; the manifest's row."""
    m = op.build(op.metadata_tuning(d.corpus()), new_path(d.spark, "root"), "tuning", 1, source="metadata_tuning")
    return m.select("name", "version", "n_rows", "content_hash", "split_fracs", "created_by")


@query("dataset_manifest")
def _(d):
    return op.build(op.unsupervised(d.embeddings()), new_path(d.spark, "root"), "vectors", 1, source="vectors", split=False).drop("path", "created_at")


@query("schema_infer", """SELECT (SELECT count(*) FROM corpus) AS n_rows, name, type FROM (VALUES ('doc_id', 'string'), ('year', 'bigint'), ('region', 'string'),
 ('credibility_score', 'double'), ('outcome_reported', 'boolean')) t(name, type)""")
def _(d):
    """Types found in a file of JSON lines, by a full pass instead of the first record."""
    path = new_path(d.spark, "infer")
    ndjson.write(d.corpus().select("doc_id", "year", "region", "credibility_score", "outcome_reported"), path)
    found = d.spark.read.json(path)
    fields = F.array(*[F.struct(F.lit(f["name"]).alias("name"), F.lit(f["type"]).alias("type")) for f in op.schema_of(found)])
    return found.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(fields))


@query("scan_ndjson", "SELECT doc_id, title, year, region, outcome_reported, round(credibility_score, 6) AS credibility_score, n_pages FROM corpus")
def _(d):
    """Written as JSON lines, loaded with a declared schema into a table, and read from there."""
    schema = "doc_id string, title string, year int, region string, outcome_reported boolean, credibility_score double, n_pages int"
    src, target = new_path(d.spark, "ndjson"), new_path(d.spark, "table")
    ndjson.write(d.corpus().select("doc_id", "title", "year", "region", "outcome_reported", "credibility_score", "n_pages"), src)
    ndjson.load(d.spark, src, schema, target)
    return d.spark.read.schema(schema).parquet(target).withColumn("credibility_score", F.round("credibility_score", 6))


@query("sink_ndjson", "SELECT count(*) AS n_lines, count(*) FILTER (WHERE region IS NULL) AS n_null_region FROM corpus")
def _(d):
    """The written lines themselves: one per row, NULL fields present."""
    path = new_path(d.spark, "sink")
    ndjson.write(d.corpus().select("doc_id", "title", "region"), path)
    return d.spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("value").contains('"region":null')).alias("n_null_region"))


@query("gold_export", "SELECT g.row_id, c.title, g.label, g.gold_source FROM gold g JOIN corpus c ON c.doc_id = g.row_id WHERE g.task_id = 'task_1'")
def _(d):
    path = new_path(d.spark, "gold")
    rows = op.gold_rows(labeling.gold(d.annotations().filter("task_id = 'task_1'")), d.corpus().select(F.col("doc_id").alias("row_id"), "title"), ["title"])
    ndjson.write(rows, path)
    return ndjson.read(d.spark, path, rows.schema)


@query("sft_export", f"""SELECT CASE WHEN split = 'test' THEN 'validation' ELSE 'train' END AS part,
 json_object('systemInstruction', json_object('role', 'system', 'parts', [json_object('text', 'Return the target for the given text.')]),
  'contents', [json_object('role', 'user', 'parts', [json_object('text', 'title: ' || title || chr(10) || 'abstract: ' || abstract)]), json_object('role', 'model', 'parts', [json_object('text', evidence_type)])])::VARCHAR AS value
FROM (SELECT *, {lang_split('doc_id')} AS split FROM corpus)""")
def _(d):
    """Chat lines written as JSON-lines files by part; the lines of those files."""
    rows = d.corpus().select(F.col("doc_id").alias("row_id"), "title", "abstract", F.col("evidence_type").alias("target"))
    lines = op.chat_examples(op.with_split(rows), ["title", "abstract"], "target", "Return the target for the given text.")
    train, validation = op.write_chat(lines, new_path(d.spark, "tuning"))
    return d.spark.read.text(train).select(F.lit("train").alias("part"), "value").unionAll(
        d.spark.read.text(validation).select(F.lit("validation").alias("part"), "value"))


@query("ctas_overwrite", "SELECT doc_id, round(p_relevant, 6) AS p_relevant FROM scores WHERE p_relevant >= 0.5")
def _(d):
    """A table replaced by its second version."""
    path = new_path(d.spark, "replaced")
    d.scores().write.parquet(path)
    d.scores().filter("p_relevant >= 0.5").write.mode("overwrite").parquet(path)
    return d.spark.read.schema("doc_id string, p_relevant double").parquet(path).withColumn("p_relevant", F.round("p_relevant", 6))


@query("insert_append", "SELECT doc_id, language FROM corpus")
def _(d):
    """Two incremental runs: each appends only documents that are not there yet."""
    path = new_path(d.spark, "appended")
    rows = d.corpus().select("doc_id", "language", "provenance")
    rows.filter("provenance = 'ingested'").drop("provenance").write.parquet(path)
    there = d.spark.read.schema("doc_id string, language string").parquet(path)
    rows.drop("provenance").join(there.select("doc_id"), "doc_id", "left_anti").write.mode("append").parquet(path)
    return d.spark.read.schema("doc_id string, language string").parquet(path)
