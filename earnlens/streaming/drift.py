"""Streaming drift monitors.

``monitor_stream``  the reference's rolling last-N window (DRF-04/06/10) in two
                    levels. Every input partition first keeps, for each
                    monitor key, only its newest ``window`` rows and their
                    count, so a hot key's rows are read where they are; keyed
                    state with ``applyInPandasWithState`` then holds the ring
                    of the last ``window`` feature rows and a monotonic total,
                    and merges at most ``window`` rows for each partition.
``drift_windows``   the event-time form (DRF-07): watermark + tumbling or
                    sliding windows of per-feature sums and counts (partial
                    aggregation, state dropped behind the watermark), joined
                    to the static baseline.
``run_windows``     keeps every window, open ones too, in an upsert table.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from earnlens.operators.joins import small
from earnlens.sources import dims
from earnlens.streaming.sinks import UpsertTable, progress_of
from earnlens.streaming.sources import run_available


#: Monitored features, at most: the baseline's rows go to the driver.
MOST_FEATURES = 10_000


def newest_rows(keys: str, order: list[str], window: int):
    """For ``mapInPandas``: of every key in a partition the newest ``window``
    rows; the first of them says how many rows there were (``_seen``)."""
    def run(batches):
        held, seen = None, {}
        for pdf in batches:
            for k, n in pdf[keys].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)
            held = pdf if held is None else pd.concat([held, pdf])
            held = held.sort_values([keys, *order], kind="stable").groupby(keys, sort=False).tail(window)
        if held is not None and len(held):
            first = ~held[keys].duplicated()
            yield held.assign(_seen=np.where(first, held[keys].map(seen), 0).astype("int64"))
    return run


def monitor_stream(stream: DataFrame, baseline: DataFrame, features: list[str],
                   window: int = dims.DRIFT_WINDOW, threshold: float = dims.DRIFT_THRESHOLD,
                   min_obs: int = dims.DRIFT_MIN_OBS, key: str | None = None,
                   order=("ts", "event_id")) -> DataFrame:
    """Per micro-batch and monitor key: one drift row per baseline feature
    (feature, current_mean, baseline_mean, z_score, drifted, window_size,
    total_observations). Fewer than ``min_obs`` in the window -> a single
    row with feature null (the 'insufficient data' report)."""
    rows = baseline.limit(MOST_FEATURES + 1).collect()  # one row per feature
    if len(rows) > MOST_FEATURES:
        raise ValueError(f"a baseline of more than {MOST_FEATURES} features")
    base = {r["feature"]: (float(r["mean"]), float(r["std"])) for r in rows}
    bfeats = [f for f in features if f in base]
    keyed = stream.withColumn("_monitor", F.col(key).cast("string") if key else F.lit("all"))
    cols = ["_monitor", *order, *[F.col(f).cast("double").alias(f) for f in bfeats]]
    keyed = keyed.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields) + ", _seen long"
    keyed = keyed.mapInPandas(newest_rows("_monitor", list(order), window), schema)
    out_schema = ("monitor string, feature string, current_mean double, baseline_mean double, "
                  "z_score double, drifted boolean, window_size long, total_observations long")
    state_schema = "ring array<array<double>>, total long"
    order_cols = list(order)

    def step(k, pdfs, state):
        ring, total = ([], 0)
        if state.exists:
            ring, total = list(state.get[0]), int(state.get[1])
        # chunks of a batch come in any order: the newest rows of all of them
        newest = None
        for pdf in pdfs:
            total += int(pdf["_seen"].sum())
            newest = pdf if newest is None else pd.concat([newest, pdf])
            newest = newest.sort_values(order_cols, kind="stable").tail(window)
        if newest is not None:
            ring = (ring + newest[bfeats].to_numpy(dtype=float).tolist())[-window:]
        state.update((ring, total))
        n = len(ring)
        if n < min_obs:
            yield pd.DataFrame([{"monitor": k[0], "feature": None, "current_mean": None,
                                 "baseline_mean": None, "z_score": None, "drifted": False,
                                 "window_size": n, "total_observations": total}])
            return
        arr = np.nan_to_num(np.asarray(ring, dtype=float), nan=0.0)   # missing -> 0.0
        rows = []
        for i, f in enumerate(bfeats):
            m, (bm, bs) = float(arr[:, i].mean()), base[f]
            z = 0.0 if bs == 0 else abs(m - bm) / bs
            rows.append({"monitor": k[0], "feature": f, "current_mean": round(m, 2),
                         "baseline_mean": round(bm, 2), "z_score": round(z, 3),
                         "drifted": bool(z > threshold), "window_size": n,
                         "total_observations": total})
        yield pd.DataFrame(rows)

    return keyed.groupBy("_monitor").applyInPandasWithState(
        step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def drift_windows(stream: DataFrame, baseline: DataFrame, features: list[str],
                  ts: str = "ts", length: str = "1 day", slide: str | None = None,
                  delay: str = "1 hour", threshold: float = dims.DRIFT_THRESHOLD,
                  by: str | None = None) -> DataFrame:
    """DRF-07: event-time windows. Late rows behind the watermark are dropped
    (Spark counts them in the query progress). Output per window (and ``by``
    value): feature, n, current_mean, z_score, drifted; in append mode once the
    window is closed, in update mode whenever it changes."""
    from earnlens.functions.text import epoch_micros
    # naive wall clocks are taken as UTC instants (session-time-zone free);
    # windows align to the epoch, so day windows are UTC days
    s = stream.withColumn("_ts", F.timestamp_micros(epoch_micros(ts, dict(stream.dtypes)[ts])))
    s = s.withWatermark("_ts", delay)
    w = F.window("_ts", length, slide) if slide else F.window("_ts", length)
    keys = [w.alias("window")] + ([F.col(by)] if by else [])
    agg = s.groupBy(*keys).agg(F.count("*").alias("n"),
                               *[F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"_s_{f}")
                                 for f in features])
    long = agg.select("window", *([by] if by else []), "n", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col(f"_s_{f}") / F.col("n")).alias("current_mean"))
        for f in features])).alias("x")).select("window", *([by] if by else []), "n", "x.*")
    b = baseline.select("feature", F.col("mean").alias("baseline_mean"),
                        F.col("std").alias("baseline_std"))
    j = long.join(small(b, MOST_FEATURES), "feature")  # static, one row per feature
    z = F.when(F.col("baseline_std") == 0, 0.0).otherwise(
        F.abs(F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_std"))
    return j.select(F.unix_seconds(F.col("window.start")).alias("window_start"),
                    F.unix_seconds(F.col("window.end")).alias("window_end"),
                    *([by] if by else []), "feature", "n", "current_mean",
                    z.alias("z_score"), (z > threshold).alias("drifted"))


def run_windows(windows: DataFrame, location: str, by: str | None = None) -> tuple[DataFrame, int]:
    """Runs :func:`drift_windows` over what its source holds, in update mode,
    into an upsert table under ``location``. Returns all windows, with
    ``closed`` (behind the watermark: it will not change any more), and how
    many rows came too late for their window."""
    spark = windows.sparkSession
    table = UpsertTable(spark, os.path.join(location, "windows"), ["window_start", *([by] if by else []), "feature"])
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "100000")  # all of the run's progress
    try:
        query = run_available(windows.writeStream.outputMode("update").foreachBatch(lambda df, n: table.upsert(df)), location)
        progress = progress_of(query)
    finally:
        spark.conf.set(kept, before)
    mark = F.unix_micros(F.to_timestamp(F.lit(progress["watermark"]))) if progress["watermark"] else F.lit(0)
    closed = F.col("window_end") * 1_000_000 <= mark
    return table.rows(windows.schema).withColumn("closed", closed), progress["late"]
