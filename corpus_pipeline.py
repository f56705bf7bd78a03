"""A corpus pipeline of five operators of ``earnlens.llm``.

``STAGES`` are (name, function) pairs; each function takes ``(spark, docs,
sf_dir)`` and returns the next stage's documents, the last one the packing.
``run`` writes each stage as Parquet in the shared checkpoint folder and reads
it again. No SQL expresses the first stage, so ``ORACLE_SQL`` is None; the
tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.llm import exact_dedup, minhash_dedup, queries, substring_dedup, toxicity
from earnlens.llm.common import bounded_batches, read_table, stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir, docs), queries.TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeated word runs go; ``n_chars`` follows the text."""
    cut = substring_dedup.cut_repeated_runs(docs)
    n_chars = F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of a model's length."""
    return queries.pack_documents(docs, queries.ADDED)


def bounded(function: Callable) -> Callable:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return function(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("toxicity", bounded(clean)),
    ("exact dedup", bounded(without_copies)),
    ("near dedup", bounded(without_near_copies)),
    ("substring dedup", bounded(without_repeats)),
    ("packing", bounded(packed)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
