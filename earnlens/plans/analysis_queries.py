"""Statistics, profiling, data-quality, cleaning, drift and provenance
queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnlens.functions.text import first_digits, recode, title_case, to_number
from earnlens.operators import clean as cl
from earnlens.operators import drift as dr
from earnlens.operators import profile as pr
from earnlens.operators import provenance as pv
from earnlens.operators import stats as st
from earnlens.operators.integrate import duplicate_count
from earnlens.operators.requests import normalise_requests, validation_report
from earnlens.plans.explore_queries import _BM
from earnlens.plans.modelviews import S, split_cohort
from earnlens.plans.registry import query, r4
from earnlens.plans.sqlviews import P, PW, PWC, with_views, PERSONS, WAGES
from earnlens.sources import dims
from earnlens.sources import testbed as tb
from earnlens.sources.tables import read_table

# ------------------------------------------------------------------ statistics
_GS = """g AS (SELECT education_level, count(*) AS n, avg(annual_income) AS mean,
                var_pop(annual_income) AS vp FROM persons GROUP BY 1),
t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum(n * vp) AS ssw FROM g)"""


@query("anova_by_level", P + "," + _GS + """
SELECT round((sum(g.n * power(g.mean - t.grand, 2)) / (t.k - 1)) / (t.ssw / (t.nn - t.k)), 4) AS f_stat,
       CAST(t.k - 1 AS BIGINT) AS df_between, CAST(t.nn - t.k AS BIGINT) AS df_within
FROM g, t GROUP BY t.k, t.nn, t.ssw""")
def q_anova(spark, sf):
    return r4(st.anova(tb.persons(spark, sf), "education_level", "annual_income", with_p=False))


@query("anova_by_level_p")
def q_anova_p(spark, sf):
    return r4(st.anova(tb.persons(spark, sf), "education_level", "annual_income"))


@query("anova_by_region_p")
def q_anova_region(spark, sf):
    return r4(st.anova(tb.persons(spark, sf), "region", "annual_income"))


_TWO = """s AS (SELECT count(*) FILTER (WHERE gender = 'Male') AS n_a,
              avg(annual_income) FILTER (WHERE gender = 'Male') AS mean_a,
              var_samp(annual_income) FILTER (WHERE gender = 'Male') AS var_a,
              count(*) FILTER (WHERE gender = 'Female') AS n_b,
              avg(annual_income) FILTER (WHERE gender = 'Female') AS mean_b,
              var_samp(annual_income) FILTER (WHERE gender = 'Female') AS var_b FROM persons)"""


@query("welch_t", P + "," + _TWO + """
SELECT round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 4) AS t_stat,
       round(power(var_a / n_a + var_b / n_b, 2)
             / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)), 4) AS df,
       round(mean_a - mean_b, 4) AS gap, n_a, n_b FROM s""")
def q_welch(spark, sf):
    return r4(st.welch_t(tb.persons(spark, sf), "gender", "Male", "Female", "annual_income",
                         with_p=False))


@query("welch_t_p")
def q_welch_p(spark, sf):
    return r4(st.welch_t(tb.persons(spark, sf), "gender", "Male", "Female", "annual_income"))


@query("cohens_d", P + "," + _TWO + """,
d AS (SELECT (mean_a - mean_b) / sqrt((var_a + var_b) / 2) AS d FROM s)
SELECT round(d, 4) AS cohens_d,
       CASE WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect
FROM d""")
def q_cohen(spark, sf):
    return r4(st.cohens_d(tb.persons(spark, sf), "gender", "Male", "Female", "annual_income"))


@query("tukey_pairs", P + "," + _GS + """
SELECT a.education_level AS group1, b.education_level AS group2,
       round(b.mean - a.mean, 4) AS meandiff,
       round(sqrt(t.ssw / (t.nn - t.k) / 2 * (1.0 / a.n + 1.0 / b.n)), 4) AS se,
       round(abs(b.mean - a.mean) / sqrt(t.ssw / (t.nn - t.k) / 2 * (1.0 / a.n + 1.0 / b.n)), 4) AS q_stat
FROM g a JOIN g b ON a.education_level < b.education_level, t""")
def q_tukey(spark, sf):
    return r4(st.tukey_hsd(tb.persons(spark, sf), "education_level", "annual_income",
                           with_p=False))


@query("tukey_hsd")
def q_tukey_p(spark, sf):
    return r4(st.tukey_hsd(tb.persons(spark, sf), "education_level", "annual_income"))


@query("jarque_bera", P + """,
m AS (SELECT avg(annual_income) AS mu, count(*) AS n FROM persons),
c AS (SELECT n, avg(power(annual_income - mu, 2)) AS m2, avg(power(annual_income - mu, 3)) AS m3,
             avg(power(annual_income - mu, 4)) AS m4 FROM persons, m GROUP BY n),
k AS (SELECT n, m3 / power(m2, 1.5) AS s, m4 / power(m2, 2) - 3 AS kk FROM c)
SELECT n, round(s, 4) AS skewness, round(kk, 4) AS excess_kurtosis,
       round(n / 6.0 * (s * s + kk * kk / 4), 4) AS jb_stat,
       round(exp(-(n / 6.0 * (s * s + kk * kk / 4)) / 2), 4) AS p_value FROM k""")
def q_jb(spark, sf):
    return r4(st.jarque_bera(tb.persons(spark, sf), "annual_income"))


@query("ks_normality")
def q_ks(spark, sf):
    return r4(st.ks_normal(tb.persons(spark, sf), "annual_income"))


_LCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS corr FROM lineitem"
    for i, a in enumerate(_LCOLS) for b in _LCOLS[i + 1:]) + ")")
def q_corr(spark, sf):
    return r4(st.corr_long(read_table(spark, sf, "lineitem"), _LCOLS))


@query("ols_line", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 4) AS r2,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def q_ols(spark, sf):
    return r4(st.ols_line(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("premium_market_ols", P.rstrip() + ",\n" + _BM + """,
d AS (SELECT p.premium, m.market_size FROM prem p
      JOIN (SELECT state, count(*) AS market_size FROM persons WHERE annual_income >= 100000 GROUP BY 1) m USING (state))
SELECT round(regr_slope(premium, market_size), 4) AS slope, round(regr_intercept(premium, market_size), 4) AS intercept,
       round(regr_r2(premium, market_size), 4) AS r2, CAST(regr_count(premium, market_size) AS BIGINT) AS n FROM d""")
def q_premium_ols(spark, sf):
    from earnlens.operators.explore import premium_vs_market_size
    from earnlens.plans.explore_queries import bucket_col
    d = premium_vs_market_size(tb.persons(spark, sf), bucket=bucket_col())
    return r4(st.ols_line(d, "market_size", "premium"))


@query("vif")
def q_vif(spark, sf):
    c = tb.cohort(spark, sf)
    return r4(st.vif(c, ["age", "education_ord", "employment", "location_quotient",
                         "jobs_per_1000", "hourly_mean", "annual_mean_wage"]))


_QS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}


@query("income_distribution", P + "SELECT education_level, " + ", ".join(
    f"round(quantile_cont(annual_income, {v}), 4) AS {k}" for k, v in _QS.items())
    + " FROM persons GROUP BY 1")
def q_dist(spark, sf):
    return r4(st.distribution(tb.persons(spark, sf), "education_level", "annual_income"))


@query("histogram_60", P + """,
mm AS (SELECT min(annual_income) AS lo, max(annual_income) AS hi FROM persons),
b AS (SELECT CAST(least(floor((annual_income - lo) / (hi - lo) * 60) + 1, 60) AS INTEGER) AS bin,
             lo, hi FROM persons, mm)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 60, 4) AS bin_lo,
       round(lo + bin * (hi - lo) / 60, 4) AS bin_hi, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def q_hist(spark, sf):
    return r4(st.histogram(tb.persons(spark, sf), "annual_income", 60))


# ------------------------------------------------------------------ profiling
_PCOLS = ["annual_income", "age", "location_quotient"]


@query("describe_numeric", PWC + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
        round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
        round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max
        FROM cohort""" for c in _PCOLS) + ")")
def q_describe(spark, sf):
    return r4(pr.describe_numeric(tb.cohort(spark, sf), _PCOLS))


_DCOLS = ["state", "occupation", "education_level", "gender"]


@query("distinct_profile", PWC + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct FROM cohort""" for c in _DCOLS)
    + ")")
def q_distinct(spark, sf):
    return pr.distinct_profile(tb.cohort(spark, sf), _DCOLS)


@query("duplicate_count", """
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber
                                               FROM lineitem)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
         AS duplicate_rows FROM lineitem""")
def q_dups(spark, sf):
    return duplicate_count(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("shape", PWC + "SELECT count(*) AS rows, 14 AS columns FROM cohort")
def q_shape(spark, sf):
    return pr.shape(tb.cohort(spark, sf))


_EXP_LEVELS = tuple(dims.TESTBED_EDUCATION_ORDER)


@query("expectation_report", PWC + """
SELECT * FROM (
  SELECT 'not_null:annual_income' AS rule, count(*) FILTER (WHERE annual_income IS NULL) = 0 AS passed,
         CAST(count(*) FILTER (WHERE annual_income IS NULL) AS DOUBLE) AS observed FROM cohort
  UNION ALL SELECT 'not_null:state', count(*) FILTER (WHERE state IS NULL) = 0,
         CAST(count(*) FILTER (WHERE state IS NULL) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'row_count_in_range', count(*) BETWEEN 5000 AND 50000, CAST(count(*) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'distinct:state==25', count(DISTINCT state) = 25, CAST(count(DISTINCT state) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'min:annual_income>=100000', min(annual_income) >= 100000, min(annual_income) FROM cohort
  UNION ALL SELECT 'positive:location_quotient', count(*) FILTER (WHERE NOT location_quotient > 0) = 0,
         CAST(count(*) FILTER (WHERE NOT location_quotient > 0) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'positive:employment', count(*) FILTER (WHERE NOT employment > 0) = 0,
         CAST(count(*) FILTER (WHERE NOT employment > 0) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'range:age', count(*) FILTER (WHERE NOT age BETWEEN 16 AND 100) = 0,
         CAST(count(*) FILTER (WHERE NOT age BETWEEN 16 AND 100) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'range:education_ord', count(*) FILTER (WHERE NOT education_ord BETWEEN 1 AND 5) = 0,
         CAST(count(*) FILTER (WHERE NOT education_ord BETWEEN 1 AND 5) AS DOUBLE) FROM cohort
  UNION ALL SELECT 'in_set:gender', count(*) FILTER (WHERE gender NOT IN ('Male', 'Female')) = 0,
         CAST(count(*) FILTER (WHERE gender NOT IN ('Male', 'Female')) AS DOUBLE) FROM cohort)""")
def q_expect(spark, sf):
    return tb.cohort_report(spark, sf)


@query("expectation_scan", """
SELECT 'not_null:ts' AS rule, count(*) FILTER (WHERE ts IS NULL) = 0 AS passed, CAST(count(*) FILTER (WHERE ts IS NULL) AS DOUBLE) AS observed FROM events
UNION ALL SELECT 'distinct:event_type==5', count(DISTINCT event_type) = 5, CAST(count(DISTINCT event_type) AS DOUBLE) FROM events
UNION ALL SELECT 'min:value>=1', min(value) >= 1, min(value) FROM events
UNION ALL SELECT 'range:value', count(*) FILTER (WHERE NOT value BETWEEN 0 AND 90) = 0, CAST(count(*) FILTER (WHERE NOT value BETWEEN 0 AND 90) AS DOUBLE) FROM events
UNION ALL SELECT 'in_set:event_type', count(*) FILTER (WHERE event_type NOT IN ('click', 'signup')) = 0,
       CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'signup')) AS DOUBLE) FROM events""")
def q_expect_scan(spark, sf):
    """DQ-02..07 of a table that another job wrote; some rules fail here."""
    return pr.expectations(read_table(spark, sf, "events"), not_null=("ts",), distinct_eq=("event_type", 5), min_floor=("value", 1),
                           in_range={"value": (0, 90)}, in_set={"event_type": ("click", "signup")})


@query("dimension_checks", """
WITH r AS (SELECT n.n_name AS state FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
e AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) t(o))
SELECT 'regions_cover_states' AS rule, count(DISTINCT state) = 25 AS passed,
       CAST(count(DISTINCT state) AS DOUBLE) AS observed FROM r
UNION ALL SELECT 'regions_no_duplicate_state', count(*) = count(DISTINCT state),
       CAST(count(*) - count(DISTINCT state) AS DOUBLE) FROM r
UNION ALL SELECT 'ordinals_are_1_to_n', min(o) = 1 AND max(o) = count(*) AND count(DISTINCT o) = count(*),
       CAST(max(o) AS DOUBLE) FROM e""")
def q_dimchecks(spark, sf):
    return dims.check_dimensions(tb.region_map(spark, sf), tb.education(spark), 25)


@query("request_validation", """
SELECT o.o_orderkey AS request_id,
       (o.o_orderstatus IN ('F', 'O')
        AND (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) BETWEEN 18 AND 80) AS is_valid,
       CAST(CASE WHEN (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) BETWEEN 18 AND 80
                 THEN 0 ELSE 1 END
            + CASE WHEN o.o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END AS INTEGER) AS error_count,
       concat_ws('; ',
         CASE WHEN NOT (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) BETWEEN 18 AND 80
              THEN 'age out of range' END,
         CASE WHEN o.o_orderstatus NOT IN ('F', 'O') THEN 'invalid gender' END) AS errors
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_validation(spark, sf):
    return validation_report(normalise_requests(tb.requests(spark, sf)), tb.persons(spark, sf))


@query("null_profile_raw_wages", with_views(PERSONS, WAGES) + """,
raw AS (SELECT CASE WHEN w.jobs_per_1000 < 180 THEN NULL ELSE 1 END AS tot_emp,
               CASE WHEN w.annual_mean_wage >= 262000 THEN NULL ELSE 1 END AS h_mean FROM wages w)
SELECT 'TOT_EMP' AS "column", count(*) FILTER (WHERE tot_emp IS NULL) AS nulls FROM raw
UNION ALL SELECT 'H_MEAN', count(*) FILTER (WHERE h_mean IS NULL) FROM raw
UNION ALL SELECT 'A_MEAN', count(*) FILTER (WHERE h_mean IS NULL) FROM raw
UNION ALL SELECT 'LOC_QUOTIENT', 0 FROM raw LIMIT 4""".replace(
    "UNION ALL SELECT 'LOC_QUOTIENT', 0 FROM raw LIMIT 4",
    "UNION ALL SELECT 'LOC_QUOTIENT', CAST(0 AS BIGINT)"))
def q_nulls(spark, sf):
    raw = tb.raw_wages(spark, sf)
    num = raw.select(*[to_number(c).alias(c) for c in ("TOT_EMP", "H_MEAN", "A_MEAN",
                                                       "LOC_QUOTIENT")])
    return pr.null_profile(num)


# ------------------------------------------------------------------ cleaning
def _title_sql(x: str) -> str:
    s = f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13)))"
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({s}, i - 1, 1), '^\\p{{L}}$') THEN upper(substr({s}, i, 1)) "
            f"ELSE lower(substr({s}, i, 1)) END), '')")


_RAW_WAGES = """raw_wages AS (
  SELECT ' ' || chr(9) || lower(w.state) || chr(10) || ' ' AS AREA_TITLE,
         CASE n.n_nationkey WHEN 3 THEN 'GU' WHEN 7 THEN 'PR' WHEN 11 THEN 'VI' WHEN 19 THEN 'DC'
              ELSE 'N' || CAST(n.n_nationkey AS VARCHAR) END AS PRIM_STATE,
         printf('%.4f', w.location_quotient) AS LOC_QUOTIENT,
         lpad(CAST(length(w.occupation) AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(ascii(w.occupation) AS VARCHAR), 4, '0') AS OCC_CODE,
         lower(w.occupation) || ' first-line workers' AS OCC_TITLE,
         CASE WHEN w.jobs_per_1000 < 180 THEN '**' ELSE printf('%.0f', w.employment) END AS TOT_EMP,
         printf('%.4f', w.jobs_per_1000) AS JOBS_1000,
         CASE WHEN w.annual_mean_wage >= 262000 THEN '#' ELSE printf('%.2f', w.hourly_mean) END AS H_MEAN,
         CASE WHEN w.annual_mean_wage >= 262000 THEN '#' ELSE printf('%.2f', w.annual_mean_wage) END AS A_MEAN
  FROM wages w JOIN nation n ON w.state = n.n_name)"""


def _num_sql(c):
    return (f"CASE WHEN regexp_matches({c}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


_CLEAN_WAGES_SELECT = f"""
SELECT * FROM (
  SELECT {_title_sql('AREA_TITLE')} AS STATE, PRIM_STATE, round({_num_sql('LOC_QUOTIENT')}, 4) AS LOC_QUOTIENT,
         replace(OCC_CODE, '-', '') AS OCC_CODE, {_title_sql('OCC_TITLE')} AS OCC_TITLE,
         round({_num_sql('TOT_EMP')}, 4) AS TOT_EMP, round({_num_sql('JOBS_1000')}, 4) AS JOBS_1000,
         round({_num_sql('H_MEAN')}, 4) AS H_MEAN, round({_num_sql('A_MEAN')}, 4) AS A_MEAN
  FROM raw_wages)
WHERE OCC_CODE IS NOT NULL AND OCC_CODE <> '' AND STATE IS NOT NULL AND PRIM_STATE IS NOT NULL
  AND LOC_QUOTIENT IS NOT NULL AND OCC_TITLE IS NOT NULL AND TOT_EMP IS NOT NULL
  AND JOBS_1000 IS NOT NULL AND H_MEAN IS NOT NULL AND A_MEAN IS NOT NULL
  AND PRIM_STATE NOT IN ('GU', 'PR', 'VI', 'DC') AND (A_MEAN >= 100000 OR H_MEAN >= 48.08)"""


@query("clean_wages", with_views(PERSONS, WAGES, _RAW_WAGES) + _CLEAN_WAGES_SELECT)
def q_clean_wages(spark, sf):
    return r4(cl.clean_wages(tb.raw_wages(spark, sf)))


@query("clean_title_case", f"""
SELECT p_partkey, {_title_sql("replace(p_name, ' ', '-') || ' ' || p_brand || ' o''neil'")} AS title
FROM part""")
def q_title(spark, sf):
    p = read_table(spark, sf, "part")
    src = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit(" "), F.col("p_brand"),
                   F.lit(" o'neil"))
    return p.select("p_partkey", title_case(src).alias("title"))


@query("clean_code_digits", """
SELECT p_partkey,
       CASE WHEN regexp_extract(p_brand, '(\\d+)', 1) = '' THEN NULL
            WHEN length(regexp_extract(p_brand, '(\\d+)', 1)) < 6
              THEN lpad(regexp_extract(p_brand, '(\\d+)', 1), 6, '0')
            ELSE regexp_extract(p_brand, '(\\d+)', 1) END AS brand_code,
       CASE WHEN regexp_extract(p_type, '(\\d+)', 1) = '' THEN NULL
            ELSE regexp_extract(p_type, '(\\d+)', 1) END AS type_code
FROM part""")
def q_digits(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", first_digits("p_brand").alias("brand_code"),
                    first_digits("p_type").alias("type_code"))


@query("recode_passthrough", """
SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'Male' WHEN 'O' THEN 'Female' END,
                            o_orderstatus) AS gender FROM orders""")
def q_recode(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", recode("o_orderstatus", {"F": "Male", "O": "Female"}).alias("gender"))


@query("clean_numeric_coerce", f"""
SELECT event_id, {_num_sql("regexp_extract(props, '\"k\": ([^}}]*)', 1)")} AS k FROM events""")
def q_coerce(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", to_number(F.regexp_extract("props", r'"k": ([^}]*)', 1)).alias("k"))


# ------------------------------------------------------------------ drift
_FEATS = ["age", "education_ord", "gender_bin"]
_BASE_SQL = """feat AS (SELECT 'age' AS feature, CAST(age AS DOUBLE) AS v FROM split WHERE split = 'train'
          UNION ALL SELECT 'education_ord', CAST(education_ord AS DOUBLE) FROM split WHERE split = 'train'
          UNION ALL SELECT 'gender_bin', CASE WHEN gender = 'Male' THEN 1.0 ELSE 0.0 END
                    FROM split WHERE split = 'train'),
base AS (SELECT feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std,
                round(min(v), 4) AS min, round(max(v), 4) AS max FROM feat GROUP BY 1)"""


def _baseline(spark, sf):
    tr = split_cohort(spark, sf).where("split = 'train'").withColumn(
        "gender_bin", (F.col("gender") == "Male").cast("int"))
    return dr.drift_baseline(tr, _FEATS)


@query("drift_baseline", S + "," + _BASE_SQL + " SELECT * FROM base")
def q_baseline(spark, sf):
    return _baseline(spark, sf)


@query("drift_report", S + "," + _BASE_SQL + """,
win AS (SELECT o.o_orderkey, CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) AS DOUBLE) AS age,
               CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS education_ord,
               CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS gender_bin
        FROM orders o WHERE o.o_orderstatus IN ('F', 'O')
          AND (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) BETWEEN 18 AND 80
        ORDER BY o.o_orderkey DESC LIMIT 500),
cur AS (SELECT 'age' AS feature, avg(age) AS m, count(*) AS n FROM win
        UNION ALL SELECT 'education_ord', avg(education_ord), count(*) FROM win
        UNION ALL SELECT 'gender_bin', avg(gender_bin), count(*) FROM win),
z AS (SELECT b.feature, c.m, b.mean, c.n,
             CASE WHEN b.std = 0 THEN 0.0 ELSE abs(c.m - b.mean) / b.std END AS z
      FROM base b JOIN cur c USING (feature) WHERE c.n >= 30)
SELECT feature, round(m, 2) AS current_mean, round(mean, 2) AS baseline_mean, round(z, 3) AS z_score,
       z > 2.0 AS drifted, n AS window_size, max(CASE WHEN z > 2.0 THEN 1 ELSE 0 END) OVER () = 1
         AS any_drifted FROM z""")
def q_drift(spark, sf):
    from earnlens.operators.requests import validate_requests
    good, _ = validate_requests(normalise_requests(tb.requests(spark, sf)), tb.persons(spark, sf))
    obs = good.select("request_id", F.col("age").cast("double").alias("age"),
                      F.substring("education_level", 1, 1).cast("double").alias("education_ord"),
                      (F.col("gender") == "Male").cast("double").alias("gender_bin"))
    win = dr.last_n(obs, 500, order=("request_id",)).drop("request_id")
    return dr.drift_report(win, _baseline(spark, sf))


@query("rolling_window_mean", """
SELECT event_id, event_type, value,
       round(avg(CAST(value AS DECIMAL(38,10))) OVER w, 10) AS rolling_mean, count(value) OVER w AS rolling_n
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id
                         ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)""")
def q_rolling(spark, sf):
    e = read_table(spark, sf, "events")
    # ten decimals: the mean of up to 500 values of two decimals has no half there to round
    return r4(dr.rolling_mean(e, "event_type", "value", 500, exact=True).drop("ts"), 10)


# ------------------------------------------------------------------ provenance
_FP_COLS = ["person_id", "state", "gender", "age", "education_level", "occupation", "annual_income"]
_FP_SQL = """fp AS (
  SELECT lower(lpad(hex(CAST(s % 18446744073709551616 AS UBIGINT)), 16, '0')) AS fingerprint, rows
  FROM (SELECT sum(CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST(person_id AS VARCHAR), state,
                   gender, CAST(age AS VARCHAR), education_level, occupation,
                   CAST(CAST(annual_income AS DECIMAL(18, 2)) AS VARCHAR))), 1, 15)) AS UBIGINT)
                   AS HUGEINT)) AS s, count(*) AS rows FROM cohort))"""


@query("data_fingerprint", PWC.rstrip() + ",\n" + _FP_SQL + " SELECT * FROM fp")
def q_fp(spark, sf):
    return pv.fingerprint(tb.cohort(spark, sf), _FP_COLS, money=("annual_income",))


@query("model_version", PWC.rstrip() + ",\n" + _FP_SQL + """
SELECT 'earnlens+unknown.' || substr(fingerprint, 1, 12) AS model_version, fingerprint, rows FROM fp""")
def q_version(spark, sf):
    return pv.model_version(pv.fingerprint(tb.cohort(spark, sf), _FP_COLS, money=("annual_income",)),
                            code_sha="unknown")


# ------------------------------------------------------------ raw sources
def _csv_roundtrip(spark, df, label, reader):
    import os
    import uuid
    from earnlens.session import checkpoint_dir
    from earnlens.sources.io import write_table
    path = os.path.join(checkpoint_dir(spark), "raw", f"{label}-{uuid.uuid4().hex[:12]}.csv")
    write_table(df, path, fmt="csv")                 # SNK-01: header, no index
    return reader(spark, path)


@query("raw_wages_csv", with_views(PERSONS, WAGES, _RAW_WAGES) + _CLEAN_WAGES_SELECT)
def q_raw_wages_csv(spark, sf):
    """SRC-01 + SNK-01: the raw wage text written as CSV, read back with the
    all-text schema, then cleaned."""
    from earnlens.sources.io import read_wages
    raw = _csv_roundtrip(spark, tb.raw_wages(spark, sf), "wages", read_wages)
    return r4(cl.clean_wages(raw))


_RAW_PERSONS = """rp AS (
  SELECT CAST(c.c_nationkey AS INTEGER) AS STATEICP, ascii(c.c_mktsegment) AS DEGFIELDD,
         100 + CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS EDUCD,
         substr(c.c_mktsegment, 1, 2) || '-' || CAST(c.c_custkey AS VARCHAR) AS OCCSOC,
         CAST(floor(o.o_totalprice) AS BIGINT) AS INCTOT,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 2 ELSE 3 END AS SEX,
         CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) AS INTEGER) AS AGE
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


@query("clean_persons", "WITH " + _RAW_PERSONS + """,
d AS (SELECT n.n_name AS STATE, CASE rp.EDUCD WHEN 101 THEN '1-URGENT' WHEN 102 THEN '2-HIGH'
             WHEN 103 THEN '3-MEDIUM' WHEN 104 THEN '4-NOT SPECIFIED' END AS EDUCATION,
             coalesce(CASE rp.SEX WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END, CAST(rp.SEX AS VARCHAR))
               AS SEX,
             CASE WHEN length(regexp_extract(rp.OCCSOC, '(\\d+)', 1)) < 6
                  THEN lpad(regexp_extract(rp.OCCSOC, '(\\d+)', 1), 6, '0')
                  ELSE regexp_extract(rp.OCCSOC, '(\\d+)', 1) END AS OCC_CODE,
             rp.INCTOT, rp.AGE
      FROM rp JOIN nation n ON rp.STATEICP = n.n_nationkey
      WHERE rp.INCTOT >= 100000 AND rp.DEGFIELDD IN (SELECT DISTINCT ascii(c_mktsegment) FROM customer))
SELECT STATE, EDUCATION, SEX, count(*) AS n, sum(INCTOT) AS total_income,
       count(DISTINCT OCC_CODE) AS n_codes
FROM d WHERE EDUCATION IS NOT NULL GROUP BY 1, 2, 3""")
def q_clean_persons(spark, sf):
    """SRC-02 + PRJ-07..11 + FLT-04/05: raw person CSV read with the typed
    schema, floor, digits, recode, three code lookups, null drop."""
    from earnlens.sources.io import read_persons
    raw = _csv_roundtrip(spark, tb.raw_persons(spark, sf), "persons", read_persons)
    c = cl.clean_persons(raw, *tb.person_dims(spark, sf))
    return c.groupBy("STATE", "EDUCATION", "SEX").agg(
        F.count("*").alias("n"), F.sum("INCTOT").alias("total_income"),
        F.countDistinct("OCC_CODE").alias("n_codes"))
