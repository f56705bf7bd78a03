"""Streams: two-level window, refill, late rows, upserts, replays, counters."""

import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from earnlens.operators import drift as dr
from earnlens.sources.io import write_table  # noqa: F401
from earnlens.streaming.drift import drift_windows, monitor_stream, newest_rows, run_windows
from earnlens.streaming.scoring import ScoreSink, write_batch
from earnlens.streaming.sinks import UpsertTable
from earnlens.streaming.sources import run_available

EVENT = "ts timestamp, event_id long, value double, kind string"


def arrive(spark, folder, batches):
    """One part file for each batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.startswith("part-") and f.endswith(".parquet"):
                os.rename(os.path.join(folder, f), os.path.join(folder, f"{i}-{f[5:]}"))
    for i, f in enumerate(sorted(x for x in os.listdir(folder) if x.endswith(".parquet"))):
        os.utime(os.path.join(folder, f), (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def at(hour, minute=0):
    return datetime(2024, 1, 1) + timedelta(hours=hour, minutes=minute)


def test_newest_rows_of_a_partition():
    parts = [pd.DataFrame({"m": ["a", "b", "a"], "t": [5, 1, 1], "v": [1.0, 2.0, 3.0]}),
             pd.DataFrame({"m": ["a", "a"], "t": [4, 2], "v": [4.0, 5.0]})]
    out, = newest_rows("m", ["t"], 2)(iter(parts))
    assert sorted(zip(out.m, out.t, out._seen)) == [("a", 4, 4), ("a", 5, 0), ("b", 1, 1)]
    assert list(newest_rows("m", ["t"], 2)(iter([]))) == []


def test_window_refills_on_the_stream(spark, tmp_path):
    """DRF-06: one monitor, drifted values and then normal ones; of many rows of
    one key each partition passes on the window's size at most."""
    baseline = spark.createDataFrame([("value", 10.0, 1.0)], "feature string, mean double, std double")
    batches = [[(at(0), i, 30.0, "x") for i in range(60)], [(at(1), 100 + i, 10.0, "x") for i in range(40)],
               [(at(2), 200 + i, 10.0, "x") for i in range(40)]]
    stream = arrive(spark, str(tmp_path / "in"), batches)
    out = str(tmp_path / "out")
    window = monitor_stream(stream, baseline, ["value"], window=50, key=None)
    run_available(window.writeStream.format("parquet").option("path", out), out)
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r.total_observations)
    assert [(r.total_observations, r.window_size, r.drifted) for r in rows] == [(60, 50, True), (100, 50, True), (140, 50, False)]
    assert rows[1].current_mean == 14.0 and rows[2].current_mean == 10.0


def test_one_key_is_read_where_it_is(spark):
    df = spark.range(4000).repartition(8).select(F.lit("all").alias("m"), "id")
    cut = df.mapInPandas(newest_rows("m", ["id"], 20), "m string, id long, _seen long")
    assert cut.count() == 8 * 20 and cut.agg(F.sum("_seen")).first()[0] == 4000
    newest = {r.id for r in cut.orderBy(F.desc("id")).limit(20).collect()}
    assert newest == set(range(3980, 4000))


def test_open_windows_and_late_rows(spark, tmp_path):
    baseline = spark.createDataFrame([("value", 10.0, 1.0)], "feature string, mean double, std double")
    batches = [[(at(0, 5), 1, 10.0, "a"), (at(1, 5), 2, 14.0, "a")], [(at(0, 30), 3, 20.0, "a"), (at(5), 4, 1.0, "b")],
               [(at(5, 10), 6, 3.0, "b")], [(at(0, 10), 5, 99.0, "a")]]
    stream = arrive(spark, str(tmp_path / "in"), batches)
    d = drift_windows(stream, baseline, ["value"], length="1 hour", delay="2 hours", by="kind")
    out, late = run_windows(d, str(tmp_path / "run"), by="kind")
    start = int((at(0) - datetime(1970, 1, 1)).total_seconds())
    rows = {((r.window_start - start) // 3600, r.kind): (r.n, r.current_mean, r.closed) for r in out.collect()}
    assert rows == {(0, "a"): (2, 15.0, True), (1, "a"): (1, 14.0, True), (5, "b"): (2, 2.0, False)}
    assert late == 1  # the row of 00:10 came when the batch before had begun with a watermark of 03:00


def test_upserts_touch_their_partitions_only(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["p", "k"])
    kind = "p int, k string, v int"
    table.upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], kind))
    files = {f for f in os.listdir(tmp_path / "t" / "p=2")}
    change = spark.createDataFrame([(1, "a", 10), (3, "c", 5)], kind)
    for _ in range(2):  # a replay
        table.upsert(change)
        assert sorted(tuple(r) for r in table.rows(change.schema).select("p", "k", "v").collect()) == [
            (1, "a", 10), (1, "b", 2), (2, "a", 3), (3, "c", 5)]
    assert {f for f in os.listdir(tmp_path / "t" / "p=2")} == files


@pytest.fixture(scope="module")
def requests(spark):
    from earnlens.sources import testbed as tb
    return tb.requests(spark, "/root/testdata/sf0.001").cache()


def test_replayed_batch_changes_nothing(spark, requests, tmp_path):
    """DRF-08/09: scores, window and counts after batches 0, 1 and 1 again, and
    against all requests at once."""
    from earnlens.plans.ml_queries import artefacts, engineered
    from earnlens.sources import testbed as tb
    sf = "/root/testdata/sf0.001"
    art, persons = artefacts(spark, sf), tb.persons(spark, sf)
    features = ["age", "occ_mean_income"]
    baseline = dr.drift_baseline(engineered(spark, sf)[0], features)
    state = lambda s: (sorted(tuple(r) for r in s.window.last().collect()), s.crossings().first(),
                       s.scores.rows().count(), s.observed().first()[0], sorted(tuple(r) for r in s.drift(baseline).collect()))
    parts = [requests.where("request_id % 2 = 0"), requests.where("request_id % 2 = 1")]
    sink = ScoreSink(spark, str(tmp_path / "two"))
    for i, part in enumerate(parts):
        write_batch(part, i, art, persons, sink, features=features, window=100)
    once = state(sink)
    write_batch(parts[1], 1, art, persons, sink, features=features, window=100)
    assert state(sink) == once
    whole = ScoreSink(spark, str(tmp_path / "one"))
    write_batch(requests, 0, art, persons, whole, features=features, window=100)
    assert state(whole) == once and once[3] == once[1].scored == once[2] and len(once[0]) == 100
