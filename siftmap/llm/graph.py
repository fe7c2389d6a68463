"""Connected components by alternating large and small stars, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmap.session import new_path


#: Rows of narrow tables, and of those with texts or bitmaps, that a task writes before another one is worth its while.
NARROW_ROWS, WIDE_ROWS = 1 << 18, 1 << 12


def gathered(frame: DataFrame, rows: int, each: int = NARROW_ROWS) -> DataFrame:
    """The frame in about rows / `each` partitions, as many as there are cores at least, if it has more; nothing is shuffled again.

    Every task that writes a row makes a folder, and on a local disk Hadoop starts a process (chmod) for each: until that process has
    its own program, it counts as a second executor of the same memory. Small tables in very many files are slow to read, too.
    """
    return frame.coalesce(max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: lineage ends there and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """`e` holds u > v; every v and u itself is tied to the least v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, rows: int) -> DataFrame:
    """Columns node and root (the least node of its component) for every node with an edge to another node.

    `rows`: about how many edges there are; it decides on the partitions of the first round only, as no round has more than the one before.
    Rounds grow with the logarithm of the longest path. Group minima combine before the shuffle, so a node with very
    many edges is an ordinary row count; the joins on it can be split by adaptive execution.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(gathered(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows), "edges")
    seen = _mark(e)
    while seen[0]:
        e = stored(gathered(_small(_large(e)), seen[0]), "edges")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A supplied table; files are found by Spark, whatever the store."""
    from siftmap.sources.tables import table as read

    return read(spark, base, name)
