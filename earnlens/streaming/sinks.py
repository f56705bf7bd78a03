"""Sinks for ``foreachBatch`` that a replayed batch leaves as they are: tables
of a folder for each batch, and upserts by key."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.session import materialize
from earnlens.sources.tables import path_exists


class BatchLedger:
    """A table of one folder for each batch; a batch that runs again replaces
    its own folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def folder(self, batch: int) -> str:
        return os.path.join(self.path, f"batch_id={batch}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.folder(batch))

    def before(self, batch: int) -> DataFrame | None:
        """The rows of the batch before, if there is one."""
        path = self.folder(batch - 1)
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def rows(self) -> DataFrame:
        """All batches, with ``batch_id``."""
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def last(self) -> DataFrame:
        rows = self.rows()
        newest = rows.agg(F.max("batch_id")).first()[0]
        return rows.where(F.col("batch_id") == newest).drop("batch_id")


class UpsertTable:
    """A table with one row for each key, partitioned by the key's first
    column. A batch replaces the rows of its keys: the partitions it touches
    are read, merged and overwritten, the others stay untouched."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def upsert(self, batch: DataFrame) -> None:
        first = self.keys[0]
        batch = materialize(batch)
        merged = batch
        if path_exists(self.spark, self.path):
            have = self.spark.read.schema(batch.schema).parquet(self.path)
            touched = have.join(batch.select(first).distinct(), first, "left_semi")
            merged = materialize(touched.join(batch.select(*self.keys), self.keys, "left_anti").unionByName(batch))
        merged.repartition(first).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(first).parquet(self.path)

    def rows(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path)


def progress_of(query) -> dict:
    """What a finished query's progress says: its last ``watermark`` (text, or
    None) and ``late``, the rows that came behind it."""
    done = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]
    marks = [p["eventTime"]["watermark"] for p in done if p.get("eventTime", {}).get("watermark")]
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in done for op in p.get("stateOperators", []))
    return {"watermark": max(marks, default=None), "late": late}
