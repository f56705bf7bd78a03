"""Streaming queries: each replays a supplied table as a file stream with an
``availableNow`` trigger into a sink under the shared checkpoint folder and
returns the sink's contents."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from earnlens.operators import drift as dr
from earnlens.plans.registry import query, r4
from earnlens.plans.scoring_sql import CROSSINGS, SCORED_REQUESTS, SCORES
from earnlens.sources import testbed as tb
from earnlens.sources.tables import read_table
from earnlens.streaming.drift import drift_windows, monitor_stream, run_windows
from earnlens.streaming.scoring import ScoreSink, stream_score
from earnlens.streaming.sources import run_available, stream_location, table_stream


def _events_baseline(spark, sf):
    return dr.drift_baseline(read_table(spark, sf, "events"), ["value"])


@query("drift_stream_window", """
WITH b AS (SELECT round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events),
r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS total,
             row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
w AS (SELECT event_type, avg(coalesce(value, 0)) AS m, count(*) AS n, max(total) AS total FROM r WHERE rn <= 500 GROUP BY 1),
z AS (SELECT w.*, b.mean, CASE WHEN b.std = 0 THEN 0 ELSE abs(m - b.mean) / b.std END AS z FROM w, b)
SELECT event_type AS monitor, CASE WHEN n >= 30 THEN 'value' END AS feature,
       CASE WHEN n >= 30 THEN round(m, 2) END AS current_mean, CASE WHEN n >= 30 THEN round(mean, 2) END AS baseline_mean,
       CASE WHEN n >= 30 THEN round(z, 3) END AS z_score, n >= 30 AND z > 2.0 AS drifted,
       n AS window_size, total AS total_observations FROM z""")
def q_stream_window(spark, sf):
    loc = stream_location(spark, "drift-window")
    s = monitor_stream(table_stream(spark, sf, "events"), _events_baseline(spark, sf), ["value"],
                       window=500, key="event_type")
    run_available(s.writeStream.format("parquet").outputMode("append").option("path", loc), loc)
    return spark.read.parquet(loc)


@query("drift_event_time", """
WITH b AS (SELECT round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events),
w AS (SELECT date_trunc('day', ts) AS ws, event_type, count(*) AS n, avg(value) AS m
      FROM events GROUP BY 1, 2)
SELECT CAST(epoch(ws) AS BIGINT) AS window_start, event_type, 'value' AS feature, n,
       round(m, 9) AS current_mean,
       round(CASE WHEN b.std = 0 THEN 0 ELSE abs(m - b.mean) / b.std END, 9) AS z_score,
       CASE WHEN b.std = 0 THEN false ELSE abs(m - b.mean) / b.std > 2.0 END AS drifted,
       ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed
FROM w, b""")
def q_event_time(spark, sf):
    """Every window, the open ones of the last day too."""
    d = drift_windows(table_stream(spark, sf, "events"), _events_baseline(spark, sf), ["value"],
                      length="1 day", delay="1 hour", by="event_type")
    out, _ = run_windows(d, stream_location(spark, "drift-event-time"), by="event_type")
    return r4(out.select("window_start", "event_type", "feature", "n", "current_mean", "z_score",
                         "drifted", "closed"), 9)


#: Part files that the scored orders arrive in, one for each micro-batch.
ORDER_FILES = 4


def _stream_scores(spark, sf) -> ScoreSink:
    """Orders arriving file by file, scored once a session."""
    from earnlens.plans.ml_queries import _memo, artefacts, known_values

    def run():
        loc = stream_location(spark, "stream-score")
        orders = read_table(spark, sf, "orders")
        files = os.path.join(loc, "arriving")
        orders.repartitionByRange(ORDER_FILES, "o_orderkey").write.parquet(files)
        arriving = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(files)
        q = stream_score(tb.requests(spark, sf, orders=arriving), artefacts(spark, sf), known_values(spark, sf), loc,
                         os.path.join(loc, "_checkpoint"))
        q.awaitTermination()
        return ScoreSink(spark, loc)

    return _memo(spark, sf, "stream-score", run)


@query("stream_score", SCORES.format(more=""))
def q_stream_score(spark, sf):
    return _stream_scores(spark, sf).scores.rows().drop("batch_id")


@query("crossing_counter", CROSSINGS)
def q_crossings(spark, sf):
    return _stream_scores(spark, sf).crossings()


_OBSERVED = ["age", "education_ord", "occ_mean_income"]


@query("stream_observed_drift", SCORED_REQUESTS + """,
om AS (SELECT occupation, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM inc GROUP BY 1),
tf AS (SELECT i.age, i.education_ord, om.m AS occ_mean_income FROM inc i JOIN om USING (occupation)),
rf AS (SELECT r.request_id, r.age, CAST(substr(r.education_level, 1, 1) AS INTEGER) AS education_ord,
              coalesce(om.m, (SELECT avg(m) FROM om)) AS occ_mean_income
       FROM requests r LEFT JOIN om USING (occupation) ORDER BY request_id DESC LIMIT 500),
b AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM tf" for c in _OBSERVED) + """),
w AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS m, count(*) AS n FROM rf" for c in _OBSERVED) + """)
SELECT feature, round(m, 2) AS current_mean, round(mean, 2) AS baseline_mean, round(abs(m - mean) / std, 3) AS z_score,
       abs(m - mean) / std > 2.0 AS drifted, n AS window_size, (SELECT count(*) FROM requests) AS total_observations
FROM w JOIN b USING (feature)""")
def q_stream_drift(spark, sf):
    """DRF-08: the newest 500 scored requests against the training features."""
    from earnlens.plans.ml_queries import engineered
    sink = _stream_scores(spark, sf)
    train, _, om, sm, raw = engineered(spark, sf)
    baseline = dr.drift_baseline(train, _OBSERVED)
    return sink.drift(baseline).where(F.col("feature").isin(*_OBSERVED)).drop("any_drifted").join(F.broadcast(sink.observed()))
