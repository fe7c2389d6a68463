"""Reviewer decisions as a stream of files.

Every job drains what has arrived and stops (`availableNow`), so it can run on a schedule; state
and progress live in the checkpoint folder, and a restarted job continues where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.operators.monitoring import contradicts
from siftmap.operators.screening import validate_decisions

# `ts` is declared as an instant: zone-less times in the files then count as UTC in any session
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a Parquet folder, or over files given by a glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def utc_date(instant: str) -> Column:
    """The UTC calendar day of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def drain(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def ingest(decisions: DataFrame, types: list[str], out: str, checkpoint: str) -> None:
    """Append accepted decisions, each id once, however late they come.

    What has been stored is the memory: a batch is joined against the ids of earlier batches, so nothing has to be forgotten
    and no state grows in the executors. A repeated batch overwrites its own folder.
    """
    good = validate_decisions(decisions, types).filter(F.col("rejected_because").isNull()).drop("rejected_because")
    spark = decisions.sparkSession
    spark.createDataFrame([], good.schema).write.mode("ignore").parquet(f"{out}/batch=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema("decision_id string, batch bigint").parquet(out).filter(F.col("batch") < batch_id)
        new = batch.dropDuplicates(["decision_id"]).join(before.select("decision_id"), "decision_id", "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(good.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_per_document(decisions: DataFrame, out: str, checkpoint: str) -> None:
    """The newest decision of each document within each batch; `current` merges the batches, `compact` their files.

    Batches are summed up on their own, so no state is kept. A repeated batch overwrites its own folder, so retries leave no copies.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        newest = F.max_by(F.struct("decision_type", "decided_at", "decision_id"), F.struct("decided_at", "decision_id"))
        latest = batch.filter(F.col("decision_type").like("screen_%")).groupBy("doc_id").agg(newest.alias("s")).select("doc_id", "s.*")
        latest.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(decisions.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


LATEST = "doc_id string, decision_type string, decided_at timestamp, decision_id string"


def compact(spark: SparkSession, out: str, to: str) -> None:
    """One row per document of all batches of `out`, written to the fresh folder `to` as its first batch."""
    rows = spark.read.schema(f"{LATEST}, batch bigint").parquet(out)
    newest = F.max_by(F.struct("decision_type", "decided_at", "decision_id"), F.struct("decided_at", "decision_id"))
    rows.groupBy("doc_id").agg(newest.alias("s")).select("doc_id", "s.*").write.parquet(f"{to}/batch=-1")


def current(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.schema(f"{LATEST}, batch bigint").parquet(out)
    return rows.groupBy("doc_id").agg(F.max_by("decision_type", F.struct("decided_at", "decision_id")).alias("human_decision"))


def daily_counts(decisions: DataFrame, out: str, checkpoint: str) -> None:
    """Decisions per day, document and kind of each batch; the batches add up, so late rows count and no day has to be closed.

    Counting comes first and scores join later, in `daily_report`: a document that holds a third
    of a day's decisions is combined map-side here and is one row per kind there.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        day = utc_date("decided_at").alias("day")
        counts = batch.groupBy(day, "doc_id", "decision_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(decisions.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def daily_report(counts: DataFrame, scores: DataFrame) -> DataFrame:
    """Decision mix and overrides per day; a decision without a score is never an override."""
    over = F.coalesce(contradicts(), F.lit(False))
    return counts.join(scores.select("doc_id", "p_relevant"), "doc_id", "left").groupBy("day", "decision_type").agg(
        F.sum("n").alias("n"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("n_override")
    )
