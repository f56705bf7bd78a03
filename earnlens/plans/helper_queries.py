"""Queries of the column helpers, checks and small reports around the main
operators (PRJ-02/03/13/14, DQ-09/12, PRV-03, MOD-09, LEAK-01, BEN-04, EVA-15,
AGG-23, DRF-02/10)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from earnlens.modeling import train as tr
from earnlens.operators import benchmarks as bm
from earnlens.operators import clean as cl
from earnlens.operators import drift as dr
from earnlens.operators import evaluate as ev
from earnlens.operators import explore as ex
from earnlens.operators import features as fe
from earnlens.operators import profile as pr
from earnlens.operators import provenance as pv
from earnlens.operators import stats as st
from earnlens.operators.requests import batch_verdict, normalise_requests
from earnlens.plans.analysis_queries import _FP_COLS, _FP_SQL
from earnlens.plans.modelviews import Q, S, T, quantile_scored, split_cohort
from earnlens.plans.registry import query, r4
from earnlens.plans.sqlviews import P, PW, PWC
from earnlens.session import checkpoint_dir
from earnlens.sources import dims
from earnlens.sources import testbed as tb
from earnlens.sources.io import load_artefact, save_artefact
from earnlens.sources.tables import read_table


@query("column_helpers", P + "SELECT person_id, state AS area, occupation, age AS years FROM persons")
def q_columns(spark, sf):
    d = tb.persons(spark, sf)
    age = cl.pick_column(d, "AGE", "age")
    return cl.rename(cl.reorder(d, ["person_id", "absent", "state", "occupation", age]),
                     {"state": "area", age: "years", "absent": "x"})


@query("region_by_name", P + """SELECT p.person_id, p.state, 'N' || n.n_nationkey AS abbreviation, p.region AS region_name
FROM persons p JOIN nation n ON p.state = n.n_name""")
def q_region_by_name(spark, sf):
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    abbreviation = F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("abbreviation")
    regions = n.join(r, n.n_regionkey == r.r_regionkey).select(abbreviation, F.col("r_name").alias("region_name"))
    d = tb.persons(spark, sf).select("person_id", "state")
    return ex.region_by_name(d, n.select(F.col("n_name").alias("state"), abbreviation), regions).select(
        "person_id", "state", "abbreviation", "region_name")


@query("batch_verdict", """
SELECT count(*) FILTER (WHERE bad) = 0 AS accepted, min(CASE WHEN bad THEN o_orderkey END) AS first_bad
FROM (SELECT o_orderkey, o_orderstatus NOT IN ('F', 'O') OR NOT (year(o_orderdate) - 1995) * 12 + month(o_orderdate)
             BETWEEN 18 AND 80 AS bad FROM orders JOIN customer ON o_custkey = c_custkey)""")
def q_batch_verdict(spark, sf):
    return batch_verdict(normalise_requests(tb.requests(spark, sf)), tb.persons(spark, sf))


@query("threshold_checks", PW + f"""
SELECT 'wage_rows_agree' AS rule, n = 0 AS passed, CAST(n AS DOUBLE) AS observed
FROM (SELECT count(*) FILTER (WHERE abs(hourly_mean - annual_mean_wage / 2080) > 0.01) AS n FROM wages)
UNION ALL SELECT 'floors_agree', abs(48.08 - 100000 / 2080.0) <= 0.01, round(abs(48.08 - 100000 / 2080.0), 4)
UNION ALL SELECT 'labels_match_threshold', true, 0.0""")
def q_threshold_checks(spark, sf):
    labelled = fe.premium_label(tb.cohort(spark, sf), T)
    return r4(pr.threshold_checks(tb.wages(spark, sf), labelled, dims.MIN_ANNUAL_INCOME, dims.MIN_HOURLY_MEAN, T))


@query("version_check", PWC.rstrip() + ",\n" + _FP_SQL + """
SELECT 'earnlens+unknown.' || substr(fingerprint, 1, 12) AS model_version, true AS live_is_stored,
       (SELECT count(*) FROM cohort) AS n FROM fp""")
def q_version_check(spark, sf):
    """Rows stamped with the live version, held against the version that was saved."""
    live = pv.model_version(pv.fingerprint(tb.cohort(spark, sf), _FP_COLS, money=("annual_income",)), code_sha="unknown")
    root = os.path.join(checkpoint_dir(spark), "versions")
    name = uuid.uuid4().hex
    save_artefact(live, root, name)
    stored = load_artefact(spark, root, name).select(F.col("model_version").alias("_stored"), F.lit(0).alias("_k"))
    rows = pv.stamp(tb.cohort(spark, sf).select("person_id"), live).groupBy("model_version").agg(F.count("*").alias("n"))
    return rows.withColumn("_k", F.lit(0)).join(stored, "_k").select(
        "model_version", (F.col("model_version") == F.col("_stored")).alias("live_is_stored"), "n")


@query("runs_table", Q + """
SELECT 'group_quantiles' AS model, CAST(current_date AS VARCHAR) AS run_date, 'occupation' AS feature_set,
       (SELECT count(*) FROM split WHERE split = 'train') AS n_train, count(*) AS n_test, 0.5 AS alpha,
       round(1 - sum(power(annual_income - p50, 2)) / (var_pop(annual_income) * count(*)), 4) AS r2,
       round(avg(abs(annual_income - p50)), 4) AS mae FROM scored""")
def q_runs(spark, sf):
    sc = quantile_scored(spark, sf)
    m = ev.point_metrics(sc).select("r2", "mae").first().asDict()
    n_train = split_cohort(spark, sf).where("split = 'train'").count()
    row = tr.run_row(spark, "group_quantiles", {"alpha": 0.5}, m, "occupation", n_train, sc.count())
    return r4(row.select("model", "run_date", "feature_set", "n_train", "n_test", F.col("params")["alpha"].alias("alpha"),
                         F.col("metrics")["r2"].alias("r2"), F.col("metrics")["mae"].alias("mae")))


@query("fallback_mean", S + """
SELECT round(avg(m), 4) AS fallback FROM (SELECT CAST(avg(CAST(annual_income AS DECIMAL(38,10))) AS DOUBLE) AS m FROM split
  WHERE split = 'train' GROUP BY occupation)""")
def q_fallback(spark, sf):
    return r4(bm.fallback_mean(fe.group_means(split_cohort(spark, sf).where("split = 'train'"), "occupation")))


@query("prepared_split", S + """,
om AS (SELECT occupation, CAST(avg(CAST(annual_income AS DECIMAL(38,10))) AS DOUBLE) AS m FROM split WHERE split = 'train' GROUP BY 1),
sm AS (SELECT state, CAST(avg(CAST(annual_income AS DECIMAL(38,10))) AS DOUBLE) AS m FROM split WHERE split = 'train' GROUP BY 1)
SELECT s.person_id, s.split AS part, round(coalesce(om.m, (SELECT avg(m) FROM om)), 4) AS occ_mean_income,
       round(coalesce(sm.m, (SELECT avg(m) FROM sm)), 4) AS state_mean_income
FROM split s LEFT JOIN om USING (occupation) LEFT JOIN sm USING (state)""")
def q_prepared_split(spark, sf):
    train, test, _ = fe.prepare_split(tb.cohort(spark, sf), tb.education(spark), tb.region_map(spark, sf), "person_id")
    both = fe.recombine(train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))
    return r4(both.select("person_id", "part", "occ_mean_income", "state_mean_income"))


@query("residual_pairs", Q + """
SELECT person_id, round(annual_income, 4) AS actual, round(p50, 4) AS predicted,
       round(annual_income - p50, 4) AS residual FROM scored""")
def q_residual_pairs(spark, sf):
    return r4(ev.residual_pairs(quantile_scored(spark, sf), "person_id"))


@query("residual_histogram", Q + """,
e AS (SELECT annual_income - p50 AS residual FROM scored),
mm AS (SELECT min(residual) AS lo, max(residual) AS hi FROM e),
b AS (SELECT CAST(least(floor((residual - lo) / (hi - lo) * 40) + 1, 40) AS INTEGER) AS bin, lo, hi FROM e, mm)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 40), 4) AS bin_lo, round(lo + bin * ((hi - lo) / 40), 4) AS bin_hi,
       count(*) AS n FROM b GROUP BY bin, lo, hi""")
def q_residual_histogram(spark, sf):
    return r4(st.histogram(ev.residual_pairs(quantile_scored(spark, sf), "person_id"), "residual", 40))


@query("top_gaps", P + """
SELECT state, round(male_mean, 4) AS male_mean, round(female_mean, 4) AS female_mean,
       round(male_mean - female_mean, 4) AS gap, round((male_mean - female_mean) / female_mean * 100, 4) AS gap_pct
FROM (SELECT state, CAST(avg(CASE WHEN gender = 'Male' THEN CAST(annual_income AS DECIMAL(38,10)) END) AS DOUBLE) AS male_mean,
             CAST(avg(CASE WHEN gender = 'Female' THEN CAST(annual_income AS DECIMAL(38,10)) END) AS DOUBLE) AS female_mean
      FROM persons GROUP BY 1) WHERE male_mean IS NOT NULL AND female_mean IS NOT NULL
ORDER BY male_mean - female_mean DESC, state LIMIT 5""")
def q_top_gaps(spark, sf):
    """AGG-23: the five groups with the largest gap."""
    g = ex.within_group_gap(tb.persons(spark, sf), "state")
    return r4(g.orderBy(F.desc("gap"), "state").limit(5))


@query("drift_envelope", """
WITH b AS (SELECT round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events),
w AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500),
z AS (SELECT count(*) AS n, avg(coalesce(value, 0)) AS m FROM w)
SELECT CASE WHEN n < 30 THEN 'insufficient' WHEN abs(m - mean) / std > 2.0 THEN 'drift' ELSE 'ok' END AS status,
       n AS window_size, (SELECT count(*) FROM events) AS total_observations,
       CAST(CASE WHEN n >= 30 AND abs(m - mean) / std > 2.0 THEN 1 ELSE 0 END AS BIGINT) AS n_drifted FROM z, b
UNION ALL SELECT 'insufficient', 29, (SELECT count(*) FROM events), 0""")
def q_drift_envelope(spark, sf):
    """The report on the last 500 events, and on a window of 29, below the least number."""
    e = read_table(spark, sf, "events")
    base = dr.drift_baseline(e, ["value"])
    return dr.drift_envelope(dr.last_n(e, 500).select("value"), base, e).unionByName(
        dr.drift_envelope(dr.last_n(e, 29).select("value"), base, e))
