"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.sources.io import scratch


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as a table under spark.checkpoint.dir and read back. Unlike a checkpoint the table carries no inferred
    constraints along, whose number doubles with every round of self-joins, and it has a known size."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
