"""Exploration queries (AGG-01..24, TOP-*, FLT-06/07) on the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnlens.operators import explore as ex
from earnlens.plans.registry import query, r4
from earnlens.plans.sqlviews import BUCKET, P, PWC
from earnlens.sources import dims
from earnlens.sources import testbed as tb


def bucket_col():
    """Test-table education buckets: priorities 1-2 Advanced, 3-4 Bachelor, 5 Lower."""
    d = F.substring("education_level", 1, 1)
    return (F.when(d.isin("1", "2"), "Advanced").when(d.isin("3", "4"), "Bachelor")
            .otherwise("Lower"))


@query("top_groups_by_mean_income", P + """
SELECT occupation, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income, count(*) AS n
FROM persons WHERE annual_income >= 100000
GROUP BY occupation ORDER BY mean_income DESC, occupation LIMIT 10""")
def q_top_groups(spark, sf):
    return r4(ex.top_groups_by_mean(tb.persons(spark, sf), "occupation", k=10))


@query("top_states_by_mean_income", P + """
SELECT state, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income, count(*) AS n
FROM persons GROUP BY state ORDER BY avg(CAST(annual_income AS DECIMAL(38,10))) DESC, state LIMIT 20""")
def q_top_state_income(spark, sf):
    return r4(ex.top_k(tb.persons(spark, sf), "state", "annual_income", "avg", 20,
                       out="mean_income"))


@query("mean_income_by_level_ordered", P + """
SELECT d.education_level, d.education_ord, round(a.mean_income, 4) AS mean_income,
       coalesce(a.n, 0) AS n
FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5))
       AS d(education_level, education_ord)
LEFT JOIN (SELECT education_level, avg(CAST(annual_income AS DECIMAL(38,10))) AS mean_income, count(*) AS n
           FROM persons GROUP BY 1) a USING (education_level)""")
def q_level_ordered(spark, sf):
    return r4(ex.mean_by_level_ordered(tb.persons(spark, sf), tb.education(spark)))


_TOPN = """SELECT {k} FROM persons GROUP BY {k} ORDER BY count(*) DESC, {k} LIMIT 10"""


@query("gender_mix_top_occupations", P + """
SELECT occupation, gender, count(*) AS n FROM persons
WHERE occupation IN (""" + _TOPN.format(k="occupation") + """)
GROUP BY 1, 2""")
def q_gender_occ(spark, sf):
    return ex.counts_within_top(tb.persons(spark, sf), "occupation", "gender", 10)


@query("gender_mix_top_states", P + """
SELECT state, gender, count(*) AS n FROM persons
WHERE state IN (""" + _TOPN.format(k="state") + """)
GROUP BY 1, 2""")
def q_gender_state(spark, sf):
    return ex.counts_within_top(tb.persons(spark, sf), "state", "gender", 10)


@query("gender_mix_by_level", P + """
SELECT education_level, gender, count(*) AS n FROM persons
WHERE annual_income >= 100000 GROUP BY 1, 2""")
def q_gender_level(spark, sf):
    return ex.counts_by(tb.persons(spark, sf), ["education_level", "gender"], floor=100000)


@query("top_occupation_counts", P + """
SELECT occupation, count(*) AS n FROM persons GROUP BY 1 ORDER BY n DESC, occupation LIMIT 10""")
def q_top_occ_counts(spark, sf):
    return ex.top_k(tb.persons(spark, sf), "occupation", agg="count", k=10)


@query("top_state_counts", P + """
SELECT state, count(*) AS n FROM persons GROUP BY 1 ORDER BY n DESC, state LIMIT 20""")
def q_top_state_counts(spark, sf):
    return ex.top_k(tb.persons(spark, sf), "state", agg="count", k=20)


@query("top_state_lq", PWC + """
SELECT state, round(avg(CAST(location_quotient AS DECIMAL(38,10))), 4) AS mean_lq, count(*) AS n FROM cohort
GROUP BY 1 ORDER BY avg(CAST(location_quotient AS DECIMAL(38,10))) DESC, state LIMIT 20""")
def q_top_state_lq(spark, sf):
    return r4(ex.top_k(tb.cohort(spark, sf), "state", "location_quotient", "avg", 20,
                       out="mean_lq"))


@query("top_wage_occupations", PWC + """
SELECT occupation, round(avg(CAST(annual_mean_wage AS DECIMAL(38,10))), 4) AS mean_wage, count(*) AS n FROM cohort
GROUP BY 1 ORDER BY avg(CAST(annual_mean_wage AS DECIMAL(38,10))) DESC, occupation LIMIT 10""")
def q_top_wage_occ(spark, sf):
    return r4(ex.top_k(tb.cohort(spark, sf), "occupation", "annual_mean_wage", "avg", 10,
                       out="mean_wage"))


@query("dominant_level_by_state", P + """
SELECT state, education_level AS dominant_level, n FROM (
  SELECT state, education_level, count(*) AS n,
         row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, education_level) AS rk
  FROM persons WHERE annual_income >= 100000 GROUP BY 1, 2) WHERE rk = 1""")
def q_dominant(spark, sf):
    return ex.dominant_level(tb.persons(spark, sf))


@query("dominant_level_state_counts", P + """
SELECT dominant_level, count(*) AS n_groups FROM (
  SELECT state, education_level AS dominant_level,
         row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, education_level) AS rk
  FROM persons WHERE annual_income >= 100000 GROUP BY 1, 2) WHERE rk = 1 GROUP BY 1""")
def q_dominant_counts(spark, sf):
    return ex.dominant_level_counts(tb.persons(spark, sf))


_BM = """bm AS (
  SELECT state,
         avg(CAST(CASE WHEN b = 'Advanced' THEN annual_income END AS DECIMAL(38,10))) AS advanced_mean,
         avg(CAST(CASE WHEN b = 'Bachelor' THEN annual_income END AS DECIMAL(38,10))) AS bachelor_mean,
         avg(CAST(CASE WHEN b = 'Lower' THEN annual_income END AS DECIMAL(38,10))) AS lower_mean
  FROM (SELECT *, """ + BUCKET + """ AS b FROM persons WHERE annual_income >= 100000)
  GROUP BY state),
prem AS (
  SELECT *, advanced_mean - greatest(bachelor_mean, lower_mean) AS premium FROM bm
  WHERE advanced_mean - greatest(bachelor_mean, lower_mean) IS NOT NULL)"""


@query("education_premium_by_state", P.rstrip() + ",\n" + _BM + """
SELECT state, round(advanced_mean, 4) AS advanced_mean, round(bachelor_mean, 4) AS bachelor_mean,
       round(lower_mean, 4) AS lower_mean, round(premium, 4) AS premium
FROM prem ORDER BY premium DESC, state LIMIT 20""")
def q_premium(spark, sf):
    return r4(ex.education_premium(tb.persons(spark, sf), bucket=bucket_col()))


@query("premium_vs_market_size", P.rstrip() + ",\n" + _BM + """
SELECT p.state, round(p.premium, 4) AS premium, m.market_size FROM prem p
JOIN (SELECT state, count(*) AS market_size FROM persons WHERE annual_income >= 100000
      GROUP BY 1) m USING (state)""")
def q_premium_market(spark, sf):
    return r4(ex.premium_vs_market_size(tb.persons(spark, sf), bucket=bucket_col()))


@query("region_income", P + """
SELECT region, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income, count(*) AS n FROM persons GROUP BY 1""")
def q_region_income(spark, sf):
    return r4(ex.region_income(tb.persons(spark, sf)))


@query("region_share", P + """
SELECT region, n, round(n / sum(n) OVER (), 4) AS share
FROM (SELECT region, count(*) AS n FROM persons WHERE region IS NOT NULL GROUP BY 1)""")
def q_region_share(spark, sf):
    return r4(ex.region_share(tb.persons(spark, sf)))


@query("region_describe", P + """
SELECT region, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income,
       round(quantile_cont(annual_income, 0.5), 4) AS median_income,
       round(stddev_samp(annual_income), 4) AS std_income, count(*) AS n
FROM persons GROUP BY 1""")
def q_region_describe(spark, sf):
    return r4(ex.region_describe(tb.persons(spark, sf)))


@query("state_summary", PWC + """
SELECT state, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income, count(*) AS n,
       round(avg(CAST(location_quotient AS DECIMAL(38,10))), 4) AS mean_lq FROM cohort GROUP BY 1""")
def q_state_summary(spark, sf):
    return r4(ex.state_summary(tb.cohort(spark, sf)))


@query("headline_tiles", P + """,
f AS (SELECT * FROM persons)
SELECT (SELECT count(*) FROM f) AS rows,
       (SELECT round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) FROM f) AS mean_income,
       (SELECT state FROM f GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 1) AS top_state,
       (SELECT occupation FROM f GROUP BY 1 ORDER BY count(*) DESC, occupation LIMIT 1)
         AS top_occupation""")
def q_tiles(spark, sf):
    return r4(ex.headline_tiles(tb.persons(spark, sf)))


_DASH_REGIONS = ("AMERICA", "EUROPE", "ASIA")
_DASH_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query("dashboard_filter", P + """,
f AS (SELECT * FROM persons WHERE region IN ('AMERICA', 'EUROPE', 'ASIA')
      AND education_level IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
      AND annual_income BETWEEN 150000 AND 400000)
SELECT (SELECT count(*) FROM f) AS rows,
       (SELECT round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) FROM f) AS mean_income,
       (SELECT state FROM f GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 1) AS top_state,
       (SELECT occupation FROM f GROUP BY 1 ORDER BY count(*) DESC, occupation LIMIT 1)
         AS top_occupation""")
def q_dashboard(spark, sf):
    f = ex.filter_cohort(tb.persons(spark, sf), _DASH_REGIONS, _DASH_LEVELS, 150000, 400000)
    return r4(ex.headline_tiles(f))


@query("gender_share_by_state", P + """
SELECT state, round(avg(CASE WHEN gender = 'Male' THEN 1.0 ELSE 0.0 END) * 100, 4) AS male_pct,
       round(avg(CASE WHEN gender = 'Female' THEN 1.0 ELSE 0.0 END) * 100, 4) AS female_pct,
       count(*) AS n FROM persons GROUP BY 1""")
def q_gender_share(spark, sf):
    return r4(ex.gender_share(tb.persons(spark, sf)))


@query("leading_occupation_by_state", P + """
SELECT state, occupation, n FROM (
  SELECT state, occupation, count(*) AS n,
         row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, occupation) AS rk
  FROM persons GROUP BY 1, 2) WHERE rk = 1""")
def q_leading_occ(spark, sf):
    return ex.leading_by_group(tb.persons(spark, sf))


@query("group_size_dilution", P + """
SELECT count(*) AS n_groups, round(quantile_cont(n, 0.5), 4) AS median_size,
       min(n) AS min_size, max(n) AS max_size,
       round(100.0 / quantile_cont(n, 0.5), 4) AS dilution_pct
FROM (SELECT occupation, state, count(*) AS n FROM persons GROUP BY 1, 2)""")
def q_dilution(spark, sf):
    return r4(ex.group_size_dilution(tb.persons(spark, sf)))


_GAP = """gap AS (
  SELECT occupation, male_mean, female_mean, male_mean - female_mean AS gap,
         (male_mean - female_mean) / female_mean * 100 AS gap_pct
  FROM (SELECT occupation,
               avg(CAST(CASE WHEN gender = 'Male' THEN annual_income END AS DECIMAL(38,10))) AS male_mean,
               avg(CAST(CASE WHEN gender = 'Female' THEN annual_income END AS DECIMAL(38,10))) AS female_mean
        FROM persons GROUP BY 1)
  WHERE male_mean IS NOT NULL AND female_mean IS NOT NULL)"""


@query("within_group_gender_gap", P.rstrip() + ",\n" + _GAP + """
SELECT occupation, round(male_mean, 4) AS male_mean, round(female_mean, 4) AS female_mean,
       round(gap, 4) AS gap, round(gap_pct, 4) AS gap_pct FROM gap""")
def q_gap(spark, sf):
    return r4(ex.within_group_gap(tb.persons(spark, sf)))


@query("gender_gap_summary", P.rstrip() + ",\n" + _GAP + """
SELECT count(*) AS n_groups, round(quantile_cont(gap, 0.5), 4) AS median_gap,
       round(quantile_cont(gap_pct, 0.5), 4) AS median_gap_pct,
       round(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END), 4) AS share_male_higher FROM gap""")
def q_gap_summary(spark, sf):
    return r4(ex.gap_summary(tb.persons(spark, sf)))


@query("valid_values", P + """
SELECT DISTINCT 'state' AS kind, CAST(state AS VARCHAR) AS value FROM persons
UNION SELECT DISTINCT 'occupation', occupation FROM persons
UNION SELECT DISTINCT 'education_level', education_level FROM persons""")
def q_valid_values(spark, sf):
    return ex.valid_values(tb.persons(spark, sf))


@query("distinct_states", P + """SELECT count(DISTINCT state) AS n_distinct_state FROM persons""")
def q_distinct_states(spark, sf):
    return ex.distinct_count(tb.persons(spark, sf), "state")


# ------------------------------------------------------------ integrate / io
from earnlens.plans.sqlviews import PWC as _PWC  # noqa: E402


@query("cohort_integrate", _PWC + """
SELECT person_id, state, occupation, gender, age, education_level, round(annual_income, 4)
         AS annual_income, employment, round(location_quotient, 4) AS location_quotient,
       round(jobs_per_1000, 4) AS jobs_per_1000, round(hourly_mean, 4) AS hourly_mean,
       round(annual_mean_wage, 4) AS annual_mean_wage FROM cohort""")
def q_cohort(spark, sf):
    # the integrate job itself, from the raw tables (not the stored table)
    c = tb.build_cohort_table(spark, sf)
    return r4(c.select("person_id", "state", "occupation", "gender", "age", "education_level",
                       "annual_income", "employment", "location_quotient", "jobs_per_1000",
                       "hourly_mean", "annual_mean_wage"))


@query("cohort_roundtrip", _PWC + """
SELECT state, count(*) AS n, round(sum(annual_income), 2) AS total_income FROM cohort GROUP BY 1""")
def q_roundtrip(spark, sf):
    """SNK-01 + SRC-03: write the cohort partitioned by state under the
    shared checkpoint folder, read it back (partition discovery)."""
    import os
    import uuid
    from earnlens.session import checkpoint_dir
    from earnlens.sources.io import read_cohort, write_table
    path = os.path.join(checkpoint_dir(spark), "tables", f"cohort-{uuid.uuid4().hex[:12]}")
    write_table(tb.cohort(spark, sf), path, partition_by=["state"])
    back = read_cohort(spark, path)
    return back.groupBy("state").agg(F.count("*").alias("n"),
                                     F.round(F.sum("annual_income"), 2).alias("total_income"))


@query("education_bucket_counts", P + """
SELECT """ + BUCKET + """ AS bucket, count(*) AS n, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income
FROM persons GROUP BY 1""")
def q_bucket(spark, sf):
    p = tb.persons(spark, sf).withColumn("bucket", bucket_col())
    from earnlens.functions.metrics import exact_mean
    return r4(p.groupBy("bucket").agg(F.count("*").alias("n"),
                                      exact_mean("annual_income").alias("mean_income")))


@query("region_lookup", P + """
SELECT region, state, count(*) AS n FROM persons GROUP BY 1, 2""")
def q_region_lookup(spark, sf):
    """JOIN-02/PRJ-13: persons' state -> region through the dimension."""
    from earnlens.operators.joins import lookup
    p = tb.persons(spark, sf).drop("region")
    j = lookup(p, tb.region_map(spark, sf).select("state", "region"), "state")
    return j.groupBy("region", "state").agg(F.count("*").alias("n"))


#: Education labels that the order priorities stand for, from 1 to 5.
LABELS = ["Doctoral degree (PhD)", "Professional degree", "Master's degree", "Bachelor's degree", "Associate's degree"]


@query("education_bucket_labels", P + """,
l AS (SELECT annual_income, CASE education_ord WHEN 1 THEN 'Doctoral degree (PhD)' WHEN 2 THEN 'Professional degree' WHEN 3 THEN 'Master''s degree'
                                 WHEN 4 THEN 'Bachelor''s degree' ELSE 'Associate''s degree' END AS label FROM persons)
SELECT label, CASE WHEN regexp_matches(lower(label), 'phd|doctor|professional|master') THEN 'Advanced'
                   WHEN contains(lower(label), 'bachelor') THEN 'Bachelor' ELSE 'Lower' END AS bucket,
       count(*) AS n, round(avg(CAST(annual_income AS DECIMAL(38,10))), 4) AS mean_income FROM l GROUP BY 1, 2""")
def q_bucket_labels(spark, sf):
    """PRJ-12 on real labels."""
    from earnlens.functions.metrics import exact_mean
    from earnlens.functions.text import education_bucket
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("education_ord"))
    p = tb.persons(spark, sf).withColumn("label", label).withColumn("bucket", education_bucket("label"))
    return r4(p.groupBy("label", "bucket").agg(F.count("*").alias("n"), exact_mean("annual_income").alias("mean_income")))


_STATES = [(s, r) for r, states in sorted(dims.REGIONS.items()) for s in states]


@query("region_dim_lookup", P + ", s AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{s}', '{r}', {sorted(dims.REGIONS).index(r)})" for i, (s, r) in enumerate(sorted(_STATES))) + """) v(i, state, region, region_code))
SELECT s.state, s.region, s.region_code, count(*) AS n, round(sum(annual_income), 2) AS income
FROM persons p JOIN nation n ON p.state = n.n_name JOIN s ON s.i = 2 * n.n_nationkey GROUP BY 1, 2, 3""")
def q_region_dim(spark, sf):
    """SRC-04: every second state stands for a nation; persons meet its region
    through the inverted dimension."""
    from earnlens.operators.joins import lookup
    from earnlens.sources.tables import read_table
    states = F.array(*[F.lit(s) for s in sorted(s for s, _ in _STATES)])
    nation = read_table(spark, sf, "nation").select(
        F.col("n_name").alias("_nation"), F.element_at(states, (2 * F.col("n_nationkey") + 1).cast("int")).alias("_state"))
    p = tb.persons(spark, sf).drop("region").withColumnRenamed("state", "_nation")
    p = lookup(p, nation, "_nation").withColumnRenamed("_state", "state")
    p = lookup(p, dims.region_dim(spark), "state")
    return p.groupBy("state", "region", "region_code").agg(F.count("*").alias("n"), F.round(F.sum("annual_income"), 2).alias("income"))


@query("cohort_bucketed", _PWC.replace("FROM persons p JOIN wages w", "FROM (SELECT * FROM persons UNION ALL SELECT * FROM persons WHERE person_id % 7 < 2) p JOIN wages w") + """
SELECT person_id, state, occupation, gender, age, education_level, round(annual_income, 4) AS annual_income, employment,
       round(hourly_mean, 4) AS hourly_mean, (SELECT count(*) FROM persons WHERE person_id % 7 < 2) AS planted FROM cohort""")
def q_cohort_bucketed(spark, sf):
    """SNK-01, JOIN-01, DED-01: persons with planted copies, written bucketed
    by their id; neither the join nor the removal of copies shuffles them."""
    import posixpath
    import uuid
    from earnlens.operators.integrate import build_cohort
    from earnlens.operators.joins import one_row, small
    from earnlens.session import checkpoint_dir
    from earnlens.sources.io import write_bucketed
    p = tb.persons(spark, sf)
    copies = p.where("person_id % 7 < 2")
    table = write_bucketed(p.unionByName(copies), posixpath.join(checkpoint_dir(spark), "tables", f"persons-{uuid.uuid4().hex[:12]}"), ["person_id"])
    c = build_cohort(table, small(tb.wages(spark, sf)))
    c = c.select("person_id", "state", "occupation", "gender", "age", "education_level", "annual_income", "employment", "hourly_mean")
    return r4(c.join(one_row(copies.agg(F.count("*").alias("planted")))))
