"""A corpus pipeline of five stages over `documents`, each using one operator of siftmap.llm.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes each result to the shared folder and reads it again as the
next stage's input. All but the last return the columns of `documents`.

1. language_id        documents without a letter, or whose language stays undecided, go
2. line_dedup         recurring lines stay in one document; a document left without text goes, as others hold all it said
3. near_duplicates    one document of each group of linked ones stays, the one with the smallest id
4. decontamination    documents that hold a benchmark item go
5. packing            pieces of the remaining documents, placed in sequences

Of rows that repeat a doc_id and a text one stays after stage 3; of a doc_id with several texts each is decided on its own.
Rows without a doc_id come last in their group: one of them stays if none of the group has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.llm import decontamination, jaccard_tree, langid, line_templates, packing
from siftmap.llm.graph import WIDE_ROWS, gathered, stored
from siftmap.llm.queries import vocabulary
from siftmap.sources.tables import table

#: The likeliest language must have at least this share; the first of two that tie at a half is undecided.
LEAST_SHARE = 0.5
#: n-grams and similarity of near duplicates.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = vocabulary("piece_bpe_32k.model")
    langs, mass = langid.fit(docs.where(~langid.held_out()), pieces)
    return langid.keep(docs, pieces, langs, mass, LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # copies of a whole text are the next stage's
    out = line_templates.dedup(docs, exact_docs=line_templates.EXACT_DOCS, exact_texts=True)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")
    changed = out.where(left)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return gathered(changed.select(*docs.columns), docs.count(), WIDE_ROWS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = jaccard_tree.representatives(docs, SHINGLE, PERCENT).select(F.struct("doc_id", "text_key", "copies").alias("first"))
    # the caller's columns travel as one struct, so none of theirs can clash with a helper's
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(first, (F.xxhash64("row.text") == F.col("first.text_key")) & F.col("row.doc_id").eqNullSafe(F.col("first.doc_id")))
    # rows that repeat an id and a text become one where they are read, before anything is shuffled again
    repeated = kept.where("first.copies > 1").groupBy("first").agg(F.first("row").alias("row"))
    return gathered(kept.where("first.copies = 1").select("row.*").unionAll(repeated.select("row.*")), docs.count(), WIDE_ROWS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Model scores, token ids and a packing search have no SQL; tests/llm/test_pipeline.py checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
