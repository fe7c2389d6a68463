"""Prompts, passages, citations and chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmap.functions.replies import CITATION

# Fixed value: how a passage is quoted.
PASSAGE = "[%s p.%d] %s"


def prompt(instructions: str, fields: dict[str, str | Column], missing: str = "") -> Column:
    """Instructions followed by `Name: value` lines. A NULL field becomes `missing`, so that one
    unknown value does not turn the whole prompt into NULL."""
    parts = [F.lit(instructions + "\n")]
    for name, col in fields.items():
        col = F.col(col) if isinstance(col, str) else col
        parts += [F.lit(f"\n{name}: "), F.coalesce(col.cast("string"), F.lit(missing))]
    return F.concat(*parts)


# What each batch step asks for. The JSON keys are what the parsers read.
CLUSTER = 'Name the topic shared by these titles. Reply with JSON only: {"label", "sector", "evidence_focus", "coherence_guess"}.'
METADATA = (
    "Read the document and report only what it states. Reply with JSON only, keys region, country, sector, hazard, "
    "evidence_type, adaptation_type, outcome_reported, confidence_language, rationale; null where the text is silent."
)
SECOND_OPINION = (
    'Decide from the text whether the document belongs in the review. Reply with JSON only: {"decision": "include|exclude|needs_full_text", '
    '"criterion": "1|2|3|none", "agrees_with_model": true|false, "reason"}.'
)
OUTCOMES = (
    'List measured adaptation outcomes as a JSON array of {"action", "adaptation_type", "outcome_direction", "metric", "effect_size"}; [] if there are none.'
)
SYNTHESIS = (
    "Write a short synthesis from the passages alone; end each sentence with its citation as [doc_id p.N]. Reply with JSON only: "
    '{"synthesis", "confidence", "confidence_rationale", "gaps", "citations_used"}.'
)


def prelabel_instructions(field: Column, space: Column, instructions: Column) -> Column:
    return F.concat(
        F.lit("Choose one value of `"), field, F.lit("` from: "), F.array_join(F.from_json(space, "array<string>"), ", "),
        F.lit(". Instructions: "), F.coalesce(F.nullif(instructions, F.lit("")), F.lit("none")),
        F.lit('. Reply with JSON only: {"label", "confidence", "rationale"}.\n\nText:\n'),
    )


def context_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("?")) for c in cols])


def format_passages(hits: DataFrame, by: str = "topic_id") -> DataFrame:
    """The passages of each topic as one text, nearest first. A topic holds at most the k passages
    that retrieval left it."""
    line = F.format_string(PASSAGE, "doc_id", "page", "content")
    listed = F.sort_array(F.collect_list(F.struct("distance", "doc_id", line.alias("line"))))
    return hits.groupBy(by).agg(
        F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("passages"), F.count(F.lit(1)).alias("n_passages")
    )


def citations(texts: DataFrame, key: str, body: str) -> DataFrame:
    """One row per citation, in order of appearance."""
    whole = F.regexp_extract_all(body, F.lit(CITATION), F.lit(0))
    one = f"^{CITATION}$"
    return texts.select(key, F.posexplode(whole).alias("position", "c")).select(
        key, "position", F.regexp_extract("c", one, 1).alias("cited_id"), F.regexp_extract("c", one, 2).try_cast("bigint").alias("page")
    )


def resolve(cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds the cited document's columns and whether it exists.

    Citations are joined as distinct ids first: one much-cited document is one row of that join.
    """
    ids = cited.select(F.col("cited_id").alias("doc_id")).distinct()
    found = ids.join(corpus.select("doc_id", "title", "year", "region", "source_type"), "doc_id").withColumnRenamed("doc_id", "cited_id")
    return cited.join(found, "cited_id", "left").withColumn("known", F.col("source_type").isNotNull())


def citation_precision(cited: DataFrame, corpus: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Cited ids that exist, and that a reviewer marked as supporting, over all cited ids."""
    per_id = cited.groupBy("cited_id").agg(F.count(F.lit(1)).alias("n"))
    known = per_id.join(corpus.select(F.col("doc_id").alias("cited_id"), F.lit(True).alias("known")), "cited_id", "left")
    share = [F.try_divide(F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)), F.sum("n")).alias("known_share")]
    if decisions is not None:
        ok = decisions.filter(F.col("decision_type") == "citation_ok").select(F.col("doc_id").alias("cited_id")).distinct().withColumn("ok", F.lit(True))
        known = known.join(ok, "cited_id", "left")
        good = F.col("known") & F.col("ok")
        share.append(F.try_divide(F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)), F.sum("n")).alias("verified_share"))
    return known.agg(F.sum("n").alias("n_cited"), *share)


SPACE = " \t\n\r\f\v"


def _starts(lengths: pa.Array) -> pa.Array:
    """Running start offsets of pieces that were separated by two characters. Only the lengths
    travel to Python, and a batch is one cumulative sum."""
    n = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 2)])
    offsets = np.concatenate([[0], np.cumsum(n)])
    starts = ends[:-1] - np.repeat(ends[offsets[:-1]], n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(starts, pa.int32()))


def chunks(docs: DataFrame, text: str = "abstract", per_page: int = 3, offsets: bool = True) -> DataFrame:
    """Sentence-like chunks of whole texts with their true offsets, or without `offsets`, which take a step in Python.

    Blank pieces are dropped but keep their index. Each document is cut inside its own row, so
    nothing is shuffled and a long text costs time in proportion to its length.
    """
    pieces = docs.filter(F.col(text).isNotNull()).select("doc_id", F.split(text, r"\. ").alias("p"))
    if offsets:
        placed = pieces.withColumn("s", F.arrow_udf(_starts, "array<int>")(F.transform("p", F.length)))
        rows = placed.select("doc_id", F.posexplode(F.arrays_zip("p", "s")).alias("chunk_index", "z"))
        piece, places = F.col("z.p"), [F.col("z.s").alias("char_start"), (F.col("z.s") + F.length("z.p")).alias("char_end")]
    else:
        rows = pieces.select("doc_id", F.posexplode("p").alias("chunk_index", "z"))
        piece, places = F.col("z"), []
    body = F.btrim(piece, F.lit(SPACE))
    return rows.filter(body != "").select(
        F.concat("doc_id", F.lit("-c"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id",
        (1 + F.floor(F.col("chunk_index") / per_page)).cast("int").alias("page"),
        "chunk_index",
        F.concat(F.rtrim(body, F.lit(".")), F.lit(".")).alias("text"),
        *places,
    )
