"""A training corpus from raw documents: filter by quality, drop near-duplicates and benchmark leaks, mix sources, write tokens.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever their names. A mixed document may
come twice. Null and empty texts are documents without words: they are scored, are near-duplicates of each other, hold no benchmark
passage, go with their block in the mix, and become one end id. Rows with a null or repeated doc_id are told apart by their texts.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, mixing, quality, simhash, token_output
from weftline.llm.common import table
from weftline.llm.shared import shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.write_and_read(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token output", tokens),
]

#: Stages on hashes, models and files have no SQL; tests hold the pipeline against its operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        place = shared_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
