"""Readers and writers for the raw sources, the cohort and the artefacts
(SRC-01..03, SRC-05, SNK-01, SNK-02). Schemas are explicit: nothing is
inferred."""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from earnlens.operators.clean import PERSON_COLUMNS, WAGE_COLUMNS

# Raw wage table: everything arrives as text (markers like '*', '#').
WAGES_RAW = StructType([StructField(c, StringType()) for c in WAGE_COLUMNS])
PERSONS_RAW = StructType([
    StructField("STATEICP", IntegerType()), StructField("DEGFIELDD", IntegerType()),
    StructField("EDUCD", IntegerType()), StructField("OCCSOC", StringType()),
    StructField("INCTOT", LongType()), StructField("SEX", IntegerType()),
    StructField("AGE", IntegerType())])
COHORT = StructType([
    StructField("state_abbr", StringType()), StructField("state", StringType()),
    StructField("gender", StringType()), StructField("age", IntegerType()),
    StructField("education_code", IntegerType()), StructField("education_level", StringType()),
    StructField("degree_field", IntegerType()), StructField("occupation_code", StringType()),
    StructField("occupation", StringType()), StructField("annual_income", DoubleType()),
    StructField("employment", DoubleType()), StructField("location_quotient", DoubleType()),
    StructField("jobs_per_1000", DoubleType()), StructField("hourly_mean", DoubleType()),
    StructField("annual_mean_wage", DoubleType())])
assert [f.name for f in PERSONS_RAW.fields] == PERSON_COLUMNS


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return r.format(fmt).load(path)


def read_wages(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC-01: the raw wage table as text columns (CSV or Parquet)."""
    return _read(spark, path, WAGES_RAW, fmt)


def read_persons(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC-02: comma-delimited person microdata with a header."""
    return _read(spark, path, PERSONS_RAW, fmt)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: the cohort table (Parquet)."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """SNK-01: overwrite a table (CSV gets a header, no index column).
    Writes are task-parallel; partitioning by a low-cardinality column
    (e.g. state) enables partition pruning for readers."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """SNK-01: ``df`` bucketed and sorted by ``keys`` under ``path``, one file a
    bucket, and read back as a table: joins and aggregates by the keys (or by
    more columns than those) need no exchange. Choose keys that spread, such as
    an id: a key of many rows is one bucket."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "bucketed_" + hashlib.md5(path.encode()).hexdigest()[:12]
    df.repartition(n, *keys).write.mode("overwrite").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def save_artefact(df: DataFrame, root: str, name: str) -> str:
    """SNK-02: an artefact table (group means, baseline, metrics) as Parquet
    under ``root/name`` (parent folders are created by the writer)."""
    p = os.path.join(root, name)
    df.write.mode("overwrite").parquet(p)
    return p


def load_artefact(spark: SparkSession, root: str, name: str, required: bool = True) -> DataFrame | None:
    """SRC-05: load an artefact; a missing required one raises, a missing
    optional one (metrics) gives None."""
    p = os.path.join(root, name)
    try:
        return spark.read.parquet(p)
    except AnalysisException as e:  # any other error, such as a corrupt file, is raised as it is
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if required:
            raise FileNotFoundError(p) from e
        return None
