"""The bucketed score store: hits, expiry, pruning, no exchange, compaction."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from earnlens.operators.score import request_key
from earnlens.operators.score_store import HOUR, ScoreStore, score_through

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 5, 1, 12, 30, tzinfo=dt.timezone.utc)


@pytest.fixture()
def store(spark, tmp_path):
    from earnlens.plans.ml_queries import artefacts, valid_requests
    art, requests = artefacts(spark, SF), valid_requests(spark, SF)
    return ScoreStore(spark, str(tmp_path / "store"), ScoreStore.schema_of(art, requests), buckets=4), art, requests


def test_hits_expire(spark, store):
    kept, art, requests = store
    first = score_through(kept, requests, art, now=NOW)
    n = requests.count()
    assert first.count() == n and first.where("cache_hit").count() == 0
    later = lambda minutes: NOW + dt.timedelta(minutes=minutes)
    second = score_through(kept, requests, art, now=later(50))
    assert second.where("cache_hit").count() == n
    body = [c for c in first.columns if c != "cache_hit"]
    assert first.select(body).exceptAll(second.select(body)).count() == 0
    third = score_through(kept, requests, art, now=later(61))
    assert third.where("cache_hit").count() == 0  # scored anew, and kept beside the old ones
    assert score_through(kept, requests, art, now=later(100)).where("cache_hit").count() == n


def test_store_is_not_exchanged_and_old_hours_are_pruned(spark, store):
    kept, art, requests = store
    score_through(kept, requests.limit(50), art, now=NOW - dt.timedelta(hours=5))
    score_through(kept, requests, art, now=NOW)
    assert len(kept.hours()) == 2
    keyed = request_key(requests, art.model_version)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = kept.fresh(F.lit(NOW), 3600)
        plan = keyed.select("request_id", "payload_hash").join(fresh.drop("request_id"), "payload_hash")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    side = plan[plan.rindex("SortMergeJoin"):]
    scan = [x for x in side.splitlines() if HOUR in x and "FileScan" in x]
    assert scan and all("PartitionFilters: [isnotnull" in x and f"({HOUR}#" in x for x in scan)
    above = side[:side.index(scan[0])]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    path, low = [], depth(scan[0])
    for line in reversed(above.splitlines()):
        if line.strip() and depth(line) < low:
            path.append(line)
            low = depth(line)
    assert not any("Exchange" in x for x in path), path
    assert any("Bucketed: true" in x for x in scan)


def test_compaction_and_reopening(spark, store):
    kept, art, requests = store
    score_through(kept, requests.limit(60), art, now=NOW - dt.timedelta(hours=5))
    score_through(kept, requests.limit(300), art, now=NOW)
    score_through(kept, requests, art, now=NOW + dt.timedelta(minutes=2))
    files = lambda: sum(f.endswith(".parquet") for _, _, fs in os.walk(kept.path) for f in fs)
    before, rows = files(), kept.fresh(F.lit(NOW), 3600).count()
    kept.compact(F.lit(NOW), 3600)
    assert len(kept.hours()) == 1 and files() <= 4 < before
    assert kept.fresh(F.lit(NOW), 3600).count() == rows
    spark.sql(f"DROP TABLE {kept.table}")
    again = ScoreStore(spark, kept.path, ScoreStore.schema_of(art, requests), buckets=4)
    assert again.hours() == kept.hours() and again.fresh(F.lit(NOW), 3600).count() == rows


def test_new_scores_are_made_once(spark, store):
    """What goes into the store is what was answered, not scored again."""
    from earnlens.operators.score import memoised
    kept, art, requests = store
    out, new = memoised(request_key(requests, art.model_version), kept.fresh(F.lit(NOW), 3600), art, F.lit(NOW))
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Relation" not in plan
    assert out.count() == requests.count() and new.count() == new.select("payload_hash").distinct().count() > 0


def test_requests_meet_the_known_values(spark):
    from earnlens.operators.requests import normalise_requests, validate_requests
    from earnlens.plans.ml_queries import known_values, valid_requests
    from earnlens.sources import testbed as tb
    persons = tb.persons(spark, SF)
    assert known_values(spark, SF).count() < persons.count()
    whole, _ = validate_requests(normalise_requests(tb.requests(spark, SF)), persons)
    assert sorted(whole.select("request_id").collect()) == sorted(valid_requests(spark, SF).select("request_id").collect())
