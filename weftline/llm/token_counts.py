"""Exact token counts: a histogram of encoded lengths answers totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_path, encoder
from .shared import bounded_batches


def token_count(path: str | None = None, spaced: bool = True):
    """A Column function text -> number of tokens (null text: 0)."""
    path = path or default_path()

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(b) // 4 for b in encoder(path, spaced).column(texts)], pa.int64())

    bounded_batches()
    return F.arrow_udf(count, "long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(source, whole, length, n_docs): documents by encoded length, for each source and (``whole``) for all of them.

    Only (source, length) counts are shuffled, pre-aggregated. A null text has length 0, a null source is a source.
    """
    lengths = docs.select("source", token_count(path)(F.col("text")).alias("length"))
    by_source = lengths.groupBy("source", "length").agg(F.count("*").alias("n_docs"))
    both = by_source.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.groupBy(F.when(~F.col("whole"), F.col("source")).alias("source"), "whole", "length").agg(F.sum("n_docs").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per scope and occurring length L, taken as a context limit.

    n_docs: documents of exactly L tokens; n_up_to, tokens_up_to: of at most L; n_beyond: longer than L; truncated_total: tokens
    left if every document is cut at L (tokens_up_to + L * n_beyond); quantile: share of documents of at most L.
    The windows run over distinct lengths, not documents.
    """
    scope = Window.partitionBy("whole", "source")
    up_to = scope.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumn("n_up_to", F.sum("n_docs").over(up_to)).withColumn("tokens_up_to", F.sum(F.col("n_docs") * F.col("length")).over(up_to))
    out = out.withColumn("total", F.sum("n_docs").over(scope)).withColumn("n_beyond", F.col("total") - F.col("n_up_to"))
    return out.select("source", "whole", "length", "n_docs", "n_up_to", "n_beyond", "tokens_up_to", (F.col("tokens_up_to") + F.col("length") * F.col("n_beyond")).alias("truncated_total"), (F.col("n_up_to") / F.col("total")).alias("quantile"))


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """Truncated total of every scope for any limit, occurring or not."""
    return hist.groupBy("source", "whole").agg(F.sum(F.col("n_docs") * F.least("length", F.lit(limit))).alias("truncated_total"))
