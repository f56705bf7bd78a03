"""Reading the supplied parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table. Parquet carries its schema, so nothing is inferred;
    column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def path_status(spark: SparkSession, path: str):
    """Hadoop's status of a path of any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def input_signature(spark: SparkSession, sf_dir: str, names=TABLES) -> tuple:
    """Names, sizes and change times of the tables' files: differs once a
    table is rewritten."""
    out = []
    for n in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{n}.parquet"))
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p):
            out += [(n, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)]
    return tuple(sorted(out))
