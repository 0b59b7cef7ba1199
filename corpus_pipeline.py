"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing to target weights, packing.

Each stage takes all that the stage before it kept, as a table, and returns the columns of
``documents``; the last returns the packing of each row. A stage's result is written as Parquet in
the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language, mixing, packing, simhash, toxicity
from docloom.llm.common import written


def _whole(docs: DataFrame) -> DataFrame:
    """The row as one value, so that no column can clash with an operator's own, and a text goes to Python once."""
    return docs.select(F.struct(*docs.columns).alias("doc"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it learns from all folds of the stage's input."""
    model = language.fit(spark, docs, held=-1)
    return language.label(spark, _whole(docs), model, keep=["doc"], text="doc.text").where(~language.rejects()).select("doc.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from all labelled rows of the input."""
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held=-1)
    return toxicity.scored(spark, _whole(docs), model, keep=["doc"], text="doc.text").where("predicted = 0").select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(spark, docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken more than once is repeated."""
    return mixing.repeated(mixing.mixed(spark, docs), docs.columns)


def in_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of every row."""
    return packing.packed(spark, docs)


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near-duplicates", one_of_each), ("mixing", to_weights), ("packing", in_buckets)]
#: Models, fingerprint tries and knapsack choices have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
