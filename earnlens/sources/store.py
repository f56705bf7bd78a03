"""Processed tables written once per session and scale, like the processed
files of a cleaning run: later queries read Parquet (column pruning,
predicate push-down) instead of re-deriving the join lineage in every plan.
The folder is under the shared ``spark.checkpoint.dir``."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, Observation, SparkSession

from earnlens.session import checkpoint_dir
from earnlens.sources.tables import input_signature

_WRITTEN: dict = {}


def processed(spark: SparkSession, name: str, sf_dir: str, build, observe=None) -> DataFrame:
    """``build()`` written once as Parquet under the checkpoint folder for this
    application and state of the input folder, then read back. ``observe``:
    aggregates gathered by the writing job itself, for :func:`observed`."""
    app = spark.sparkContext.applicationId
    key = (app, name, sf_dir, input_signature(spark, sf_dir))
    if key not in _WRITTEN:
        tag = hashlib.md5(repr(key).encode()).hexdigest()[:12]
        path = os.path.join(checkpoint_dir(spark), "processed", f"{name}-{tag}")
        table = build()
        seen = Observation(name)
        if observe:
            table = table.observe(seen, *observe)
        table.write.mode("overwrite").parquet(path)
        if observe:
            metrics = seen.get
            kinds = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'long'}" for k, v in metrics.items())
            spark.createDataFrame([tuple(metrics.values())], kinds).coalesce(1).write.mode("overwrite").parquet(path + "-observed")
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def observed(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """What the job that wrote a processed table observed, as one row."""
    key = (spark.sparkContext.applicationId, name, sf_dir, input_signature(spark, sf_dir))
    return spark.read.parquet(_WRITTEN[key] + "-observed")
