"""Streaming scoring that observes what it scores (DRF-08) and counts crossed
quantiles (DRF-09).

Every micro-batch writes its own folder of five tables: scores, rejected
requests, the batch's counts, the newest observations and their total so far.
A batch that runs again replaces its folders, and builds them from the batch
before, so that a replay changes neither scores nor windows nor counts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.operators import drift as dr
from earnlens.operators.features import FEATURES_FULL
from earnlens.operators.requests import normalise_requests, validate_requests
from earnlens.operators.score import Artefacts, encode_requests, score
from earnlens.session import materialize
from earnlens.sources import dims
from earnlens.streaming.sinks import BatchLedger


class ScoreSink:
    """The tables of a scoring stream under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        at = lambda name: BatchLedger(spark, os.path.join(path, name))
        self.scores, self.rejected, self.counts, self.window = map(at, ("scores", "rejected", "counts", "window"))

    def crossings(self) -> DataFrame:
        """DRF-09: rows scored and trios crossed so far."""
        return self.counts.rows().agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"),
                                      F.coalesce(F.sum("crossings"), F.lit(0)).alias("crossings"))

    def drift(self, baseline: DataFrame, threshold: float = dims.DRIFT_THRESHOLD, min_obs: int = dims.DRIFT_MIN_OBS) -> DataFrame:
        """The drift report of the newest observations."""
        return dr.drift_report(self.window.last().drop("_order"), baseline, threshold, min_obs)

    def observed(self) -> DataFrame:
        """``total_observations``: all scored requests, not only the window's."""
        return self.counts.rows().agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("total_observations"))


def write_batch(df: DataFrame, epoch_id: int, art: Artefacts, catalogue: DataFrame, sink: str | ScoreSink,
                features=FEATURES_FULL, window: int = dims.DRIFT_WINDOW, id_col: str = "request_id") -> None:
    """One batch of raw requests, scored, observed and counted. The window
    holds the ``window`` requests of largest id so far, as encoded for scoring."""
    sink = sink if isinstance(sink, ScoreSink) else ScoreSink(df.sparkSession, sink)
    df = df.persist()  # read once for all outputs
    try:
        good, bad = validate_requests(normalise_requests(df), catalogue)
        good = materialize(good)  # read by the scores and the window
        sink.scores.write(score(good, art, id_col), epoch_id)
        sink.rejected.write(bad.select(id_col, F.array_join("errors", "; ").alias("errors")), epoch_id)
        done = sink.scores.spark.read.parquet(sink.scores.folder(epoch_id))
        sink.counts.write(crossing_counter(done), epoch_id)
        seen = encode_requests(good, art).select(F.col(id_col).alias("_order"), *[F.col(f).cast("double").alias(f) for f in features])
        earlier = sink.window.before(epoch_id)
        seen = seen if earlier is None else seen.unionByName(earlier)
        sink.window.write(seen.orderBy(F.desc("_order")).limit(window), epoch_id)
    finally:
        df.unpersist()


def stream_score(stream: DataFrame, art: Artefacts, catalogue: DataFrame, sink: str,
                 checkpoint: str, **observe):
    """Scores each micro-batch of raw requests into the tables of a
    :class:`ScoreSink`; ``observe``: what :func:`write_batch` takes."""
    return (stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, art, catalogue, sink, **observe))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def crossing_counter(scored: DataFrame) -> DataFrame:
    """DRF-09: scored rows and crossed quantile trios (of a batch, or running
    over a stream in complete or update mode)."""
    return scored.agg(F.count("*").alias("scored"),
                      F.count_if("quantiles_crossed").alias("crossings"))
