"""Decision streams whose memory is keyed state inside the stream.

Ids already seen, the newest decision of each document and the counts of each day live in Spark's state store, one entry per key, beside the
progress in the checkpoint folder. A batch touches the entries of its own keys and re-reads nothing that was stored before, however long the stream
has run; nothing is dropped for being late, so no watermark closes an entry.

What a batch changed is written as a segment of rows, the newest row of a key being its value. Segments are merged by the number of the
batch: eight of one level become one of the next, so a row is rewritten once per level and a reader opens at most seven segments of each level.
A repeated batch writes the same segments again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.operators.screening import validate_decisions
from siftmap.streaming.decisions import drain, utc_date

#: Segments of one level that become one of the next.
FAN = 8
LATEST = "doc_id string, decision_type string, decided_at timestamp, decision_id string"
DAILY = "day date, doc_id string, decision_type string, n bigint"


def cover(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Segments (level, last batch) that together hold the first `batches` batches, each once: the digits of that number."""
    out, done, level = [], 0, 0
    while fan ** (level + 1) <= batches:
        level += 1
    for k in range(level, -1, -1):
        while done + fan**k <= batches:
            done += fan**k
            out.append((k, done - 1))
    return out


def _folder(out: str, level: int, upto: int) -> str:
    return f"{out}/level={level}/upto={upto}"


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from its last batch; `batch` stays."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")


def write_segment(changed: DataFrame, batch_id: int, out: str, keys: list[str], fan: int = FAN) -> None:
    """Stores what a batch changed, and the merged segments that this batch completes."""
    spark = changed.sparkSession
    schema = changed.withColumn("batch", F.lit(batch_id).cast("bigint")).schema
    changed.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(_folder(out, 0, batch_id))
    level = 1
    while (batch_id + 1) % fan**level == 0:
        step = fan ** (level - 1)
        parts = [_folder(out, level - 1, batch_id - k * step) for k in range(fan)]
        _newest(spark.read.schema(schema).parquet(*parts), keys).write.mode("overwrite").parquet(_folder(out, level, batch_id))
        level += 1


def read_segments(spark: SparkSession, out: str, schema: str, keys: list[str], fan: int = FAN) -> DataFrame:
    """The present value of every key. Only the segments of the cover are opened; finding the last batch lists folders and reads no rows."""
    listed = spark.read.schema(f"{schema}, batch bigint, level int, upto bigint").parquet(out)
    last = listed.where("level = 0").agg(F.max("upto")).first()[0]
    if last is None:
        return spark.createDataFrame([], schema)
    parts = [_folder(out, level, upto) for level, upto in cover(int(last) + 1, fan)]
    return _newest(spark.read.schema(f"{schema}, batch bigint").parquet(*parts), keys).drop("batch")


def _run(rows: DataFrame, keep: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    drain(rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest(decisions: DataFrame, types: list[str], out: str, checkpoint: str) -> None:
    """Append accepted decisions, each id once over the whole stream, however late it is repeated: the ids seen are the state."""
    good = validate_decisions(decisions, types).filter(F.col("rejected_because").isNull()).drop("rejected_because")
    decisions.sparkSession.createDataFrame([], good.schema).write.mode("ignore").parquet(f"{out}/batch=-1")
    _run(good.dropDuplicates(["decision_id"]), lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"), checkpoint, "append")


def latest(decisions: DataFrame, out: str, checkpoint: str) -> None:
    """The newest screening decision of each document, kept up to date: a batch writes only the documents it changed."""
    newest = F.max_by(F.struct("decision_type", "decided_at", "decision_id"), F.struct("decided_at", "decision_id"))
    rows = decisions.filter(F.col("decision_type").like("screen_%")).groupBy("doc_id").agg(newest.alias("s")).select("doc_id", "s.*")
    _run(rows, lambda batch, k: write_segment(batch, k, out, ["doc_id"]), checkpoint, "update")


def current(spark: SparkSession, out: str) -> DataFrame:
    return read_segments(spark, out, LATEST, ["doc_id"]).select("doc_id", F.col("decision_type").alias("human_decision"))


def daily(decisions: DataFrame, out: str, checkpoint: str) -> None:
    """Running totals per UTC day, document and kind; late rows raise the total of their own day."""
    rows = decisions.groupBy(utc_date("decided_at").alias("day"), "doc_id", "decision_type").agg(F.count(F.lit(1)).alias("n"))
    _run(rows, lambda batch, k: write_segment(batch, k, out, ["day", "doc_id", "decision_type"]), checkpoint, "update")


def daily_totals(spark: SparkSession, out: str) -> DataFrame:
    return read_segments(spark, out, DAILY, ["day", "doc_id", "decision_type"])
