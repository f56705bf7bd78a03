"""Invariants for the non-SQL operators: quantile booster, scoring, memoised
scoring, explanations, streaming replay (SURVEY 5: bands, monotonic trios,
pinball below the constant baseline on planted signal, Shapley efficiency,
replay equals batch)."""

import os

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from earnlens.modeling import explain as xp
from earnlens.modeling.booster import QuantileBooster
from earnlens.operators import drift as dr
from earnlens.operators import evaluate as ev

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """y = exp(11.5 + .3 x1 + noise (1 + x2)), noise from a hash (FIXTURES B8)."""
    h = lambda s: (F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(s))), 1, 8), 16, 10)
                   .cast("double") / 4294967295.0)
    df = spark.range(3000).select(
        "id", (h("a") * 4).alias("x1"), h("b").alias("x2"),
        ((h("c") + h("d") + h("e") - 1.5) * 1.2).alias("z"))
    df = df.withColumn("label", F.lit(11.5) + 0.3 * F.col("x1") + F.col("z") * (1 + F.col("x2")))
    return df.cache()


def test_booster_beats_constant_and_keeps_order(spark, planted):
    tr, te = planted.where("id % 5 != 0"), planted.where("id % 5 = 0")
    m = QuantileBooster(["x1", "x2"], rounds=6, step=0.5, max_depth=2, subsample=0.9,
                        colsample=1.0, reg_lambda=1.0).fit(tr)
    sc = m.transform(te)
    pin = {a: sc.agg(F.avg(F.greatest(a * (F.col("label") - F.col(c)),
                                      (a - 1) * (F.col("label") - F.col(c))))).first()[0]
           for a, c in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))}
    const = {a: tr.agg(F.percentile_approx("label", a)).first()[0] for a in pin}
    base = {a: te.agg(F.avg(F.greatest(a * (F.col("label") - const[a]),
                                       (a - 1) * (F.col("label") - const[a])))).first()[0] for a in pin}
    assert all(pin[a] < base[a] for a in pin)
    cov = sc.agg(F.avg(F.col("label").between(F.col("q10"), F.col("q90")).cast("double"))).first()[0]
    assert 0.6 < cov < 0.95


def test_shapley_efficiency(spark, planted):
    asm = VectorAssembler(inputCols=["x1", "x2"], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="label")
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[asm, lr]).fit(planted)
    rows = planted.where("id < 20")
    bg = planted.where("id = 100")
    s = xp.shapley_values(model, rows, bg, ["x1", "x2"], "id", permutations=4)
    tot = s.groupBy("id").agg(F.sum("attribution").alias("a"))
    f = model.transform(rows).select("id", F.col("prediction").alias("fx"))
    fb = model.transform(bg).first()["prediction"]
    for r in tot.join(f, "id").collect():
        assert abs(r.a - (r.fx - fb)) < 1e-6


def test_permutation_keeps_multiset(spark, planted):
    p = xp.permuted(planted.select("id", "x1"), "x1", "id", 3, buckets=4)
    a = sorted(r.x1 for r in planted.select("x1").collect())
    b = sorted(r.x1 for r in p.select("x1").collect())
    assert a == b and p.count() == planted.count()


def test_score_batch_invariants(spark):
    from earnlens.plans.ml_queries import artefacts, valid_requests
    from earnlens.operators.score import score, score_memoised
    art = artefacts(spark, SF)
    req = valid_requests(spark, SF)
    out = score(req, art)
    assert out.count() == req.count()
    bad = out.where((F.col("predicted_p10") > F.col("predicted_p50"))
                    | (F.col("predicted_p50") > F.col("predicted_p90"))
                    | ~F.col("percentile_in_group").between(0, 100)).count()
    assert bad == 0
    empty = out.limit(0).withColumns({"payload_hash": F.lit(None).cast("string"),
                                      "scored_at": F.lit(None).cast("timestamp")})
    first, store = score_memoised(req, empty, art)
    assert first.where("cache_hit").count() == 0
    store = store.cache()
    store.count()
    second, _ = score_memoised(req, store, art)
    assert second.where("cache_hit").count() == req.count()
    stale, _ = score_memoised(req, store, art, ttl_seconds=0)
    assert stale.where("cache_hit").count() == 0


def test_event_time_stream_equals_batch(spark):
    """Every window comes, and is closed where the watermark has passed it."""
    from earnlens.plans.stream_queries import q_event_time
    s = q_event_time(spark, SF)
    ev_ = spark.read.parquet(os.path.join(SF, "events.parquet"))
    maxts = ev_.agg(F.max("ts")).first()[0]
    b = ev_.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).withColumn(
        "closed", F.col("d") + F.expr("INTERVAL 1 DAY") <= F.lit(maxts) - F.expr("INTERVAL 1 HOUR"))
    import datetime as dt
    day = lambda secs: dt.datetime.fromtimestamp(secs, dt.timezone.utc).strftime("%Y-%m-%d")
    got = {(day(r.window_start), r.event_type, r.n, r.closed) for r in s.collect()}
    want = {(str(r.d)[:10], r.event_type, r.n, r.closed) for r in b.collect()}
    assert got == want and {c for *_, c in got} == {True, False}


def test_monitor_stream_matches_batch_last_n(spark):
    from earnlens.plans.stream_queries import q_stream_window
    s = q_stream_window(spark, SF)
    e = spark.read.parquet(os.path.join(SF, "events.parquet"))
    for r in s.collect():
        last = dr.last_n(e.where(F.col("event_type") == r.monitor), 500)
        m = last.agg(F.avg("value"), F.count("*")).first()
        assert r.window_size == m[1] and abs(r.current_mean - round(m[0], 2)) < 0.011
        assert r.total_observations == e.where(F.col("event_type") == r.monitor).count()


def test_booster_save_load_roundtrip(spark, planted, tmp_path):
    from earnlens.modeling.booster import QuantileBoosterModel
    m = QuantileBooster(["x1", "x2"], rounds=2, step=0.5, max_depth=2, subsample=1.0,
                        colsample=1.0, reg_lambda=1.0).fit(planted)
    path = str(tmp_path / "booster")
    m.save(path)
    back = QuantileBoosterModel.load(spark, path)
    a = m.transform(planted.where("id < 50")).select("id", "q10", "q50", "q90").orderBy("id").collect()
    b = back.transform(planted.where("id < 50")).select("id", "q10", "q50", "q90").orderBy("id").collect()
    assert a == b


def test_artefact_save_and_load(spark, tmp_path):
    from earnlens.sources.io import load_artefact, save_artefact
    df = spark.createDataFrame([("a", 1.0)], "key string, mean double")
    save_artefact(df, str(tmp_path), "group_means")
    assert load_artefact(spark, str(tmp_path), "group_means").count() == 1
    assert load_artefact(spark, str(tmp_path), "metrics", required=False) is None
    with pytest.raises(FileNotFoundError):
        load_artefact(spark, str(tmp_path), "baseline")
