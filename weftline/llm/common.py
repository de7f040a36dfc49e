"""Small things that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name of theirs meets one that an operator adds; ``row_again`` undoes it."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")


def row_again(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in names])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
