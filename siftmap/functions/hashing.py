"""Stable hashes: the same row lands in the same bucket on every run and in every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_number(key: Column) -> Column:
    """First 32 bits of the md5 of a string key, as a non-negative bigint."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def split_of(key: Column, fracs=(0.70, 0.15, 0.15)) -> Column:
    """train / val / test by hash bucket: order-free, so adding rows never moves old ones."""
    bucket = md5_number(key) % 100
    train, val = round(fracs[0] * 100), round((fracs[0] + fracs[1]) * 100)
    return F.when(bucket < train, "train").when(bucket < val, "val").otherwise("test")


def holdout_of(key: Column, parts: int = 5) -> Column:
    """One bucket in `parts` is the test set."""
    return F.when(md5_number(key) % parts == 0, "test").otherwise("train")


def content_hash(df: DataFrame) -> DataFrame:
    """One row `(n_rows, content_hash)`; independent of row order and partitioning.

    Each row is hashed, and the hash is summed in 48-bit slices, which map tasks combine
    before the shuffle. Equal multisets of rows, and only those, give equal sums (up to
    sha-256 collisions).
    """
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    hashed = df.select(F.sha2(row, 256).alias("h"))
    parts = [
        F.coalesce(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))
        .cast("decimal(38,0)").cast("string")
        for i in range(4)
    ]
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *parts).alias("content_hash"))
