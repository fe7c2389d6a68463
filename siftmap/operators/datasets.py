"""Versioned datasets: recipes, splits, hashes, manifests and exports."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmap.functions.hashing import content_hash, split_of


def screening(corpus: DataFrame, embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """Text, vector and majority label; unlabelled documents keep a NULL label.

    Labels are aggregated on their own, so vectors and texts are never grouped.
    """
    votes = labels.groupBy("doc_id").agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    return (
        corpus.select("doc_id", "title", "abstract", "year", "region", "language", "source_type")
        .join(embeddings, "doc_id").join(votes, "doc_id", "left")
        .withColumnRenamed("doc_id", "row_id")
    )


def evidence_type(corpus: DataFrame, embeddings: DataFrame) -> DataFrame:
    c = corpus.filter(F.col("evidence_type").isNotNull())
    return c.select("doc_id", "title", "abstract", "region", "sector", "hazard", F.col("evidence_type").alias("label")).join(
        embeddings, "doc_id"
    ).withColumnRenamed("doc_id", "row_id")


def credibility(corpus: DataFrame, embeddings: DataFrame) -> DataFrame:
    c = corpus.filter(F.col("credibility_score").isNotNull())
    return c.select("doc_id", "source_type", "language", "year", "n_pages", F.col("credibility_score").alias("label")).join(
        embeddings, "doc_id"
    ).withColumnRenamed("doc_id", "row_id")


def unsupervised(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("doc_id").alias("row_id"), "embedding")


def cluster_series(yearly: DataFrame) -> DataFrame:
    return yearly.select(
        F.concat_ws("-", F.col("cluster_id").cast("string"), F.col("yr").cast("string")).alias("row_id"), "cluster_id", "yr", "n_docs"
    )


TARGET = ["region", "country", "sector", "hazard", "evidence_type", "adaptation_type", "outcome_reported", "confidence_language"]


def metadata_tuning(corpus: DataFrame) -> DataFrame:
    c = corpus.filter((F.col("provenance") == "synthetic") & (F.col("evidence_type") != "off_topic"))
    return c.select(
        F.col("doc_id").alias("row_id"), "title", "abstract",
        F.to_json(F.struct(*TARGET), {"ignoreNullFields": "false"}).alias("target_json"),
    )


def with_split(df: DataFrame, key: str = "row_id", fracs=(0.70, 0.15, 0.15)) -> DataFrame:
    return df.withColumn("split", split_of(F.col(key).cast("string"), fracs))


def next_version(datasets: DataFrame, name: str) -> DataFrame:
    return datasets.filter(F.col("name") == name).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("v"))


def schema_of(df: DataFrame) -> list[dict[str, str]]:
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]


MANIFEST = (
    "dataset_id string, name string, version bigint, path string, schema_json string, n_rows bigint, content_hash string, "
    "source string, split_fracs string, created_by string, created_at timestamp, notes string"
)


def build(
    df: DataFrame, root: str, name: str, version: int, *, source: str = "", split: bool = True,
    fracs=(0.70, 0.15, 0.15), created_by: str = "job", notes: str = "",
) -> DataFrame:
    """Write `<root>/datasets/<name>/v<version>` and a manifest; returns the one-row manifest.

    A version is written once: an existing path is an error, and so is an empty dataset. Count
    and hash come from one pass over the finished files, so they describe what was stored even if
    the input could not be reproduced.
    """
    spark: SparkSession = df.sparkSession
    if df.isEmpty():
        raise ValueError("dataset is empty")
    if "row_id" not in df.columns:
        content = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
        nth = F.row_number().over(Window.partitionBy("_content").orderBy(F.lit(1)))
        df = df.withColumn("_content", content).withColumn("_nth", nth).withColumn(
            "row_id", F.when(F.col("_nth") == 1, F.col("_content")).otherwise(F.concat_ws("-", "_content", "_nth"))
        ).drop("_content", "_nth")
    out = with_split(df, fracs=fracs) if split else df
    path = f"{root.rstrip('/')}/datasets/{name}/v{version}"
    out.write.mode("errorifexists").parquet(f"{path}/data")
    stored = content_hash(spark.read.schema(out.schema).parquet(f"{path}/data")).head()
    row = (
        hashlib.sha256(f"{name}@{version}".encode()).hexdigest(), name, version, path, json.dumps(schema_of(out)),
        stored["n_rows"], stored["content_hash"], source, json.dumps(list(fracs) if split else None), created_by, datetime.now(timezone.utc), notes,
    )
    manifest = spark.createDataFrame([row], MANIFEST)
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def preview(df: DataFrame, n: int = 20, key: str = "row_id") -> DataFrame:
    return df.drop("embedding").orderBy(key).limit(n)


def gold_rows(gold: DataFrame, rows: DataFrame, text: list[str]) -> DataFrame:
    return gold.join(rows.select("row_id", *text), "row_id").select("row_id", *text, "label", "gold_source")


def write_chat(lines: DataFrame, root: str) -> list[str]:
    """JSON-lines files of the training and of the validation part, as tuning jobs read them; returns the two folders."""
    folders = []
    for part in ("train", "validation"):
        folders.append(f"{root.rstrip('/')}/{part}")
        lines.filter(F.col("part") == part).select("value").write.text(folders[-1])
    return folders


def chat_examples(df: DataFrame, text: list[str], target: str, system: str) -> DataFrame:
    """One chat-format JSON line per row; test rows go to validation, all others to training."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in text]

    def said(role: str, what):
        return F.struct(F.lit(role).alias("role"), F.array(F.struct(what.alias("text"))).alias("parts"))

    value = F.to_json(F.struct(
        said("system", F.lit(system)).alias("systemInstruction"),
        F.array(said("user", F.array_join(F.array(*lines), "\n")), said("model", F.col(target).cast("string"))).alias("contents"),
    ))
    part = F.when(F.col("split") == "test", "validation").otherwise("train")
    return df.filter(F.col(target).isNotNull()).select("row_id", part.alias("part"), value.alias("value"))
