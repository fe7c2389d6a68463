"""Ranks and running sums over one global order, without a single-task window.

A window without PARTITION BY sends every row to one task. Here the order is cut into bins:

1. approximate quantiles of the score give the cut points (one small aggregate);
2. every row finds its bin by binary search. A score equal to a cut point gets a bin of its own,
   spread over 256 sub-bins by the hash that also breaks ties, so a score shared by a third of
   the rows is still sorted by many tasks;
3. rows are shuffled to their bins once; counts and sums per bin give what lies before each bin.
   That table has at most 257 rows per cut point, so broadcasting it is bounded by the number of
   bins, whatever the data;
4. a window inside each bin adds the rest, on the same shuffle.

Results are exact whatever the quality of the quantiles: they only balance the work.
The input is repartitioned by its key once, and that exchange serves both the quantiles and the
binning, so the input itself is read a single time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def default_depth(spark: SparkSession) -> int:
    """Levels of the binary search: about four bins per shuffle partition, 32 to 1024 in all."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(10, max(5, math.ceil(math.log2(wanted))))


def global_order(df: DataFrame, score: str, key: str, sums: tuple[str, ...] = (), depth: int | None = None) -> DataFrame:
    """`key`, `score`, `sums` plus, for the order (score desc, md5(key), key):

    `rank_no` (equal scores share a rank), `row_no`, and per summed column `<c>_running`
    (up to and including the row) and `<c>_total`; also `rows_total`. `key` must be unique.
    There are 2**depth cut points.
    """
    depth = default_depth(df.sparkSession) if depth is None else depth
    n = 2**depth
    cols = list(dict.fromkeys([key, score, *sums]))
    rows = df.select(*cols).repartition(F.col(key))
    s = F.col(score)

    fractions = [i / max(1, n - 1) for i in range(n)]
    cuts = rows.agg(F.percentile_approx(score, fractions, max(10000, 20 * n))).scalar()
    # The search: `_k<i>` counts cut points <= score, a power of two more precisely at each level.
    # Later columns of one select refer to earlier ones, so it is analysed once and runs as a
    # chain of projections in generated code.
    search, k = [cuts.alias("_c")], F.lit(0)
    for level in [*reversed(range(depth)), 0]:
        name = f"_k{len(search)}"
        search.append((k + F.when(F.get("_c", k + (2**level - 1)) <= s, 2**level).otherwise(0)).alias(name))
        k = F.col(name)
    tied = s.isNull() | F.coalesce(F.get("_c", k - 1) == s, F.lit(False))
    found = rows.select(*cols, *search, tied.alias("_tied"), F.md5(F.col(key).cast("string")).alias("_h"))
    binned = found.select(
        *cols, "_tied", "_h",
        # larger scores first; scores between two cuts come before those equal to the lower cut;
        # never NULL by type, or an IS NOT NULL filter repeating the whole search would be pushed
        # below the exchanges
        F.coalesce((2 * n + 2 - 2 * k - F.when(F.col("_tied"), 0).otherwise(1)).cast("int"), F.lit(0)).alias("_b"),
        F.coalesce(F.when(F.col("_tied"), F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")), F.lit(0)).alias("_s"),
    ).repartition("_b", "_s")

    per_bin = binned.groupBy("_b", "_s").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    before = Window.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    before_bin = Window.orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_bin.select(
        "_b", "_s",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_n").over(before_bin), F.lit(0)).alias("_bin_before"),
        F.sum("_n").over(everything).alias("rows_total"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(everything).alias(f"{c}_total") for c in sums],
    )

    # the wider order first: its sort also serves the rank, whose order is a prefix of it
    local = Window.partitionBy("_b", "_s").orderBy(F.desc_nulls_last(score), "_h", key)
    upto_row = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_score = Window.partitionBy("_b", "_s").orderBy(F.desc_nulls_last(score))
    numbered = binned.select(
        *cols, "_tied", "_b", "_s", "_h", F.row_number().over(local).alias("_row"), *[F.sum(c).over(upto_row).alias(f"_run_{c}") for c in sums]
    )
    ranked = numbered.withColumn("_rank", F.rank().over(by_score)).join(F.broadcast(offsets), ["_b", "_s"])
    return ranked.select(
        *cols,
        F.when(F.col("_tied"), F.col("_bin_before") + 1).otherwise(F.col("_rows_before") + F.col("_rank")).cast("bigint").alias("rank_no"),
        (F.col("_rows_before") + F.col("_row")).cast("bigint").alias("row_no"),
        "rows_total",
        *[(F.col(f"_before_{c}") + F.coalesce(f"_run_{c}", F.lit(0))).alias(f"{c}_running") for c in sums],
        *[f"{c}_total" for c in sums],
    )
