"""Newline-delimited JSON in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a declared schema, so the files are read once; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load(spark: SparkSession, path: str, schema: StructType | str, target: str) -> bool:
    """Replace the table at `target` with the file's rows; a missing file is skipped (False)."""
    try:
        rows = read(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    rows.write.mode("overwrite").parquet(target)
    return True
