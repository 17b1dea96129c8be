"""Result export (S4): rows as JSON lines at full precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a result as JSON lines (NULL fields omitted)."""
    df.write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an exported result back with its schema."""
    return spark.read.schema(schema).json(path)
