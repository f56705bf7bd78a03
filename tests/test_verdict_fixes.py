"""Inputs that earlier green checks did not contain."""

import math

import pytest
from earnlens.functions.dist import betainc, f_sf, ptukey, t_sf2
from earnlens.operators import benchmarks as bm
from earnlens.operators import drift as dr
from earnlens.operators import evaluate as ev
from earnlens.operators.features import hash_split
from earnlens.sources.io import load_artefact
from earnlens.sources.tables import input_signature, read_table
from earnlens.streaming.drift import monitor_stream
from earnlens.streaming.sources import run_available, stream_location, table_stream

SF = "/root/testdata/sf0.1"


def as_parts(spark, tmp_path, n=8):
    """The events as a folder of unordered part files."""
    read_table(spark, SF, "events").repartition(n, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_monitor_over_unordered_part_files(spark, tmp_path):
    parts = as_parts(spark, tmp_path)
    stream = table_stream(spark, parts, "events")
    base = dr.drift_baseline(read_table(spark, SF, "events"), ["value"])
    loc = stream_location(spark, "parts")
    out = monitor_stream(stream, base, ["value"], window=500, key="event_type")
    run_available(out.writeStream.format("parquet").outputMode("append").option("path", loc), loc)
    got = {r.monitor: r for r in spark.read.parquet(loc).collect()}
    events = read_table(spark, SF, "events").toPandas()
    assert sum(r.total_observations for r in got.values()) == len(events)
    for kind, own in events.groupby("event_type"):
        newest = own.sort_values(["ts", "event_id"]).tail(500)
        assert got[kind].window_size == 500
        assert got[kind].current_mean == pytest.approx(newest.value.mean(), abs=0.0051)


def test_null_keys_keep_one_row_per_request(spark):
    people = spark.createDataFrame(
        [("CA", "B", 1.0), ("CA", "B", 3.0), (None, "B", 100.0), ("NY", None, 50.0)], "state string, education_level string, annual_income double")
    table = bm.peer_benchmarks(people)
    assert table.where("state is null").count() == 1
    requests = spark.createDataFrame([(1, "CA", "B"), (2, None, "B"), (3, "NY", None), (4, "ZZ", "B")],
                                     "request_id long, state string, education_level string")
    rows = {r.request_id: r for r in bm.apply_benchmarks(requests, table).collect()}
    assert len(rows) == 4 and rows[1].group_median == 2.0
    assert {rows[i].group_median for i in (2, 3, 4)} == {26.5} and {rows[i].group_size for i in (2, 3, 4)} == {0}
    context = people.selectExpr("state", "education_level as occupation", "annual_income as employment",
                                "annual_income as location_quotient", "annual_income as jobs_per_1000", "annual_income as hourly_mean")
    defaults = bm.context_defaults(context)
    assert defaults.where("level = 3").count() == 1 and defaults.where("state is null and level < 3").count() == 0


def test_bands_that_must_not_be_touched(spark):
    rows = [("roc_auc", 0.99), ("roc_auc", 0.55), ("subgroup_roc_auc", 0.5), ("subgroup_roc_auc", 0.95), ("coverage_80", 0.88)]
    got = ev.metric_bands(spark.createDataFrame(rows, "metric string, value double")).collect()
    assert {(r.metric, r.value): r.passed for r in got} == {
        ("roc_auc", 0.99): False, ("roc_auc", 0.55): True, ("subgroup_roc_auc", 0.5): False,
        ("subgroup_roc_auc", 0.95): False, ("coverage_80", 0.88): True}


def test_p_values_of_very_many_degrees():
    normal = math.erfc(2 / math.sqrt(2))
    for df in (1e6, 1e8, 1e10, 1e12):
        assert t_sf2(2.0, df) == pytest.approx(normal, abs=2 / df + 1e-12)
    assert t_sf2(2.0, 1e6 - 1) == pytest.approx(t_sf2(2.0, 1e6 + 1), abs=1e-11)
    assert t_sf2(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert f_sf(4.0, 1, 10) == pytest.approx(t_sf2(2.0, 10), abs=1e-12)
    assert betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    near, far = ptukey(3.0, 3, 4999), ptukey(3.0, 3, 5001)
    assert abs(near - far) < 1e-6 and abs(ptukey(3.0, 3, 9.9e7) - ptukey(3.0, 3, 1.1e8)) < 1e-6


def test_split_of_a_fraction_of_a_percent(spark):
    n = hash_split(spark.range(100_000), "id", 0.125).where("split = 'test'").count()
    assert abs(n - 12_500) < 500


def test_unreadable_artefact_is_not_absent(spark, tmp_path):
    assert load_artefact(spark, str(tmp_path), "none", required=False) is None
    with pytest.raises(FileNotFoundError):
        load_artefact(spark, str(tmp_path), "none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        load_artefact(spark, str(tmp_path), "bad", required=False)
    assert not isinstance(e.value, FileNotFoundError)


def test_signature_follows_rewritten_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "orders.parquet"))
    before = input_signature(spark, str(tmp_path))
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    assert before != input_signature(spark, str(tmp_path))


def test_replayed_batch_adds_no_rows(spark, tmp_path):
    from earnlens.plans.ml_queries import artefacts
    from earnlens.sources import testbed as tb
    from earnlens.streaming.scoring import write_batch
    small = "/root/testdata/sf0.001"
    art, people = artefacts(spark, small), tb.persons(spark, small)
    for _ in range(2):
        write_batch(tb.requests(spark, small), 0, art, people, str(tmp_path))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert scores.count() + rejected.count() == tb.requests(spark, small).count()
    assert scores.select("request_id").distinct().count() == scores.count()


def test_drift_envelope_reports_short_windows(spark):
    from earnlens.operators import drift as dr
    base = spark.createDataFrame([("v", 0.0, 1.0)], "feature string, mean double, std double")
    total = spark.range(1000)
    rows = lambda n, v: spark.range(n).selectExpr(f"cast({v} as double) as v")
    one = lambda w: dr.drift_envelope(w, base, total).first().asDict()
    assert one(rows(29, 5)) == {"status": "insufficient", "window_size": 29, "total_observations": 1000, "n_drifted": 0}
    assert one(rows(0, 5))["status"] == "insufficient"
    assert one(rows(30, 5))["status"] == "drift" and one(rows(30, 0))["status"] == "ok"


def test_permuted_copies_change_one_column_each(spark):
    from earnlens.modeling import explain as xp
    d = spark.range(200).selectExpr("id", "cast(id as double) as a", "cast(id * 2 as int) as b")
    c = xp.permuted_copies(d, ["a", "b"], "id", 3, 1, buckets=4).toPandas()
    assert len(c) == 1200 and c.groupby(["_feature", "_repeat"]).size().eq(200).all()
    for (f, _), g in c.groupby(["_feature", "_repeat"]):
        other = "b" if f == "a" else "a"
        scale = {"a": 1, "b": 2}
        assert sorted(g[f]) == sorted(g["id"] * scale[f]) and (g[f] != g["id"] * scale[f]).any()
        assert (g[other] == g["id"] * scale[other]).all()
    assert not (c[c["_repeat"] == 0]["a"].values == c[c["_repeat"] == 1]["a"].values).all()


def test_tree_columns_score_like_the_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F
    from pyspark.ml.regression import DecisionTreeRegressor
    from earnlens.modeling.booster import _splits, _Tree
    d = spark.range(300).selectExpr("id", "cast(id % 17 as double) as a", "cast(id % 5 as double) as b",
                                    "cast((id % 17) * (id % 5) as double) as y")
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(d)
    m = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=3, leafCol="leaf").fit(x)
    t = _Tree(_splits(m._call_java("rootNode"), ["a", "b"], []))
    assert m.transform(x).where(t.column() != F.col("leaf")).count() == 0


def test_region_by_name_keeps_unknown_names(spark):
    from earnlens.operators.explore import region_by_name
    d = spark.createDataFrame([("X",), ("Nowhere",), (None,)], "state string")
    a = spark.createDataFrame([("X", "XX")], "state string, abbreviation string")
    r = spark.createDataFrame([("XX", "South")], "abbreviation string, region_name string")
    got = {x.state: x.region_name for x in region_by_name(d, a, r).collect()}
    assert got == {"X": "South", "Nowhere": None, None: None}
