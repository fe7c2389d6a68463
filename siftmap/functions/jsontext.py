"""Typed columns from JSON replies that may be fenced, cut short or not JSON at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: code-fence marks around a reply.
FENCES = "```json|```"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Put behind a reply when it is parsed, to see that nothing but the one value precedes it.
_END = "~end-of-reply~"


def _is_json(text: Column) -> Column:
    # Spark's parser ignores what follows the first value, so the text is parsed as the first of
    # two array elements: the second is found in place only if the text is exactly one value
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    return F.coalesce(F.try_variant_get(both, "$[1]", "string") == _END, F.lit(False))


def _valid(raw: str | Column) -> Column:
    """An array with the fence-free text if it is JSON, else an empty one. The text is bound once,
    so fences are stripped and the reply is parsed a single time."""
    return F.filter(F.array(F.regexp_replace(_col(raw), FENCES, "")), _is_json)


def clean_json(raw: str | Column) -> Column:
    """The reply without code fences, or NULL where it is not valid JSON."""
    return F.get(_valid(raw), F.lit(0))


def with_json(df: DataFrame, raw: str = "raw", drop_bad: bool = False) -> DataFrame:
    """Replaces `raw` by `j`, the valid JSON text or NULL.

    As a generated row, `j` is computed once however many columns and filters read it; as a plain
    projection the optimizer would repeat the parsing inside each filter it pushes down.
    """
    out = df.select(*[c for c in df.columns if c != raw], F.explode_outer(_valid(raw)).alias("j"))
    return out.filter(F.col("j").isNotNull()) if drop_bad else out


def _only_scalar(js: Column, path: str, text: Column) -> Column:
    # text that looks nested may still be a plain string; only then look at its JSON type
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(js), path, "variant"))
    return F.when(~text.rlike(r"^\s*[\[{]"), text).when(~kind.rlike("^(OBJECT|ARRAY)"), text)


def scalar(js: str | Column, path: str) -> Column:
    """A scalar at `path`; objects and arrays give NULL."""
    return _only_scalar(_col(js), path, F.get_json_object(_col(js), path))


def scalars(df: DataFrame, js: str, keys: list[str]) -> DataFrame:
    """Adds one string column per top-level key; the text is parsed once for all keys."""
    raw = df.select("*", F.json_tuple(js, *keys).alias(*[f"_{k}" for k in keys]))
    return raw.select(*df.columns, *[_only_scalar(F.col(js), f"$.{k}", F.col(f"_{k}")).alias(k) for k in keys])


def cluster_labels(replies: DataFrame) -> DataFrame:
    keys = ["label", "sector", "evidence_focus", "coherence_guess"]
    j = with_json(replies.select("cluster_id", "n_docs", "model_raw", F.col("model_raw").alias("raw")))
    return scalars(j, "j", keys).select("cluster_id", "n_docs", *keys, "model_raw")


def metadata(replies: DataFrame) -> DataFrame:
    """Nine metadata keys; replies that do not parse are dropped."""
    keys = [
        "region", "country", "sector", "hazard", "evidence_type", "adaptation_type",
        "outcome_reported", "confidence_language", "rationale",
    ]
    j = with_json(replies.select("doc_id", "raw"), drop_bad=True)
    return scalars(j, "j", keys).drop("j").withColumn("outcome_reported", F.col("outcome_reported").try_cast("boolean"))


def second_opinion(replies: DataFrame) -> DataFrame:
    """Four keys of a screening opinion; replies that do not parse stay, with NULLs."""
    j = with_json(replies)
    out = scalars(j, "j", ["decision", "criterion", "agrees_with_model", "reason"])
    return out.select(
        *[c for c in j.columns if c != "j"],
        F.col("j").isNotNull().alias("parsed"),
        F.col("decision").alias("llm_decision"),
        "criterion",
        F.col("agrees_with_model").try_cast("boolean").alias("agrees_with_model"),
        "reason",
    )


def prelabels(replies: DataFrame, task: str = "task_id", space: str = "label_space") -> DataFrame:
    """Proposed labels inside the task's label space (a JSON array of strings).

    The id is a hash of task and row, so running again gives the same ids.
    """
    j = with_json(replies.select("row_id", task, space, "raw"), drop_bad=True)
    out = scalars(j, "j", ["label", "confidence", "rationale"])
    allowed = F.from_json(F.col(space), "array<string>")
    return out.filter(F.array_contains(allowed, F.col("label"))).select(
        F.sha2(F.concat_ws("|", F.col(task), F.col("row_id")), 256).alias("label_id"),
        F.col(task).alias("task_id"),
        "row_id",
        "label",
        F.lit("llm").alias("source"),
        F.col("confidence").try_cast("double").alias("confidence"),
        "rationale",
    )


def outcome_records(replies: DataFrame, path: str | None = None) -> DataFrame:
    """One row per element of a JSON array; a reply without elements gives no row."""
    keep = [c for c in replies.columns if c != "raw"]
    array = F.get_json_object("j", path) if path else F.col("j")
    rec = "array<struct<adaptation_type:string,action:string,outcome_direction:string,metric:string,effect_size:string>>"
    # outer and then filtered: a plain explode makes the optimizer parse the array once more to
    # skip empty ones early
    rows = with_json(replies).select(*keep, F.explode_outer(F.from_json(array, rec)).alias("r")).filter(F.col("r").isNotNull())
    return rows.select(
        *keep, "r.adaptation_type", "r.action", "r.outcome_direction", "r.metric",
        F.col("r.effect_size").try_cast("double").alias("effect_size"),
    )
