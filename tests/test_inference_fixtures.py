"""The reference's exact expectations for benchmarks, context defaults,
encodings and quantile clamping (FIXTURES B1-B4)."""

from pyspark.sql import functions as F

from earnlens.functions.metrics import clamp_trio, crossed
from earnlens.operators import benchmarks as bm
from earnlens.operators import features as fe


def _b1(spark):
    rows = [("CA", "Bachelor's degree", float(v)) for v in (100000, 150000, 200000)]
    rows += [("NY", "Master's degree", float(v)) for v in (120000, 180000, 240000, 300000)]
    return spark.createDataFrame(rows, "state string, education_level string, annual_income double")


def test_peer_benchmarks_cells_and_global(spark):
    b = {(r.state, r.education_level): r for r in bm.peer_benchmarks(_b1(spark)).collect()}
    ca = b[("CA", "Bachelor's degree")]
    assert ca.group_size == 3 and ca.median_income == 150000 and ca.mean_income == 150000
    g = b[(None, None)]
    assert g.group_size == 0 and g.median_income == 180000


def test_apply_benchmarks_falls_back_to_global(spark):
    scores = spark.createDataFrame([(1, "ZZ", "PhD")], "request_id int, state string, education_level string")
    r = bm.apply_benchmarks(scores, bm.peer_benchmarks(_b1(spark))).first()
    assert r.group_size == 0 and r.group_median == 180000


def test_percentile_in_group(spark):
    inc = _b1(spark)
    sc = spark.createDataFrame(
        [(1, "CA", "Bachelor's degree", 50000.0), (2, "CA", "Bachelor's degree", 175000.0),
         (3, "CA", "Bachelor's degree", 500000.0), (4, "ZZ", "PhD", 1.0),
         (5, "CA", "Bachelor's degree", 150000.0)],
        "request_id int, state string, education_level string, predicted double")
    got = {r.request_id: r.percentile_in_group
           for r in bm.percentile_in_group(sc, inc, n_buckets=4).collect()}
    assert got == {1: 0.0, 2: 66.7, 3: 100.0, 4: 50.0, 5: 33.3}


def test_context_defaults_and_lookup(spark):
    rows = [("CA", "Software Developers", 5000.0, 1.5, 3.0, 75.0),
            ("CA", "Software Developers", 6000.0, 1.6, 3.1, 76.0),
            ("CA", "Software Developers", 7000.0, 1.4, 3.2, 74.0),
            ("NY", "Physicians", 2000.0, 0.8, 1.5, 100.0),
            ("NY", "Physicians", 2500.0, 0.9, 1.6, 105.0)]
    df = spark.createDataFrame(rows, "state string, occupation string, employment double, "
                                     "location_quotient double, jobs_per_1000 double, hourly_mean double")
    d = bm.context_defaults(df)
    cell = d.where("level = 0 AND state = 'CA'").first()
    assert cell.med_employment == 6000 and cell.med_hourly_mean == 75
    assert d.where("level = 1 AND state = 'CA'").count() == 1
    assert d.where("level = 3").count() == 1
    req = spark.createDataFrame(
        [(1, "CA", "Software Developers", None), (2, "CA", "Nurses", 0.0), (3, "TX", "X", None)],
        "request_id int, state string, occupation string, employment double")
    req = req.withColumns({c: F.lit(None).cast("double") for c in
                           ("location_quotient", "jobs_per_1000", "hourly_mean")})
    out = {r.request_id: r for r in bm.apply_context_defaults(req, d).collect()}
    assert out[1].employment == 6000 and out[1].context_level == 0
    assert out[2].employment == 0.0 and out[2].context_level == 1     # zero is a real value
    assert out[3].context_level == 3 and out[3].employment == 5000     # global median


def test_target_encoding_fallbacks(spark):
    means = spark.createDataFrame([("Software Developers", 175000.0, 1), ("Nurses", 125000.0, 1)],
                                  "occupation string, mean double, n long")
    df = spark.createDataFrame([("Pilots",), ("Nurses",)], "occupation string")
    got = {r.occupation: r.enc for r in fe.target_encode(df, means, "occupation", "enc").collect()}
    assert got == {"Pilots": 150000.0, "Nurses": 125000.0}
    empty = means.limit(0)
    assert fe.target_encode(df, empty, "occupation", "enc").first().enc == 0.0


def test_clamp_and_crossings(spark):
    trios = [(100, 150, 200), (150, 150, 150), (200, 150, 250), (100, 250, 200),
             (300, 200, 100), (200, 150, 130)]
    df = spark.createDataFrame([tuple(float(x) for x in t) for t in trios], "p10 double, p50 double, p90 double")
    lo, mid, hi = clamp_trio("p10", "p50", "p90")
    out = df.select(crossed("p10", "p50", "p90").alias("x"), lo.alias("a"), mid.alias("b"),
                    hi.alias("c")).collect()
    assert [r.x for r in out] == [False, False, True, True, True, True]
    assert [(r.a, r.b, r.c) for r in out] == [(100, 150, 200), (150, 150, 150), (150, 150, 250),
                                              (100, 250, 250), (100, 200, 300), (130, 150, 200)]
