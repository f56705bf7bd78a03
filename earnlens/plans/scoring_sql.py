"""DuckDB SQL of the scoring queries on the closed-form quantile heads."""

from earnlens.plans.modelviews import S

_REQUESTS = """requests AS (
  SELECT o.o_orderkey AS request_id, n.n_name AS state, c.c_mktsegment AS occupation,
         o.o_orderpriority AS education_level,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Male' ELSE 'Female' END AS gender,
         CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) AS INTEGER) AS age
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderstatus IN ('F', 'O') AND (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) BETWEEN 18 AND 80
    AND n.n_name IN (SELECT state FROM persons) AND c.c_mktsegment IN (SELECT occupation FROM persons)
    AND o.o_orderpriority IN (SELECT education_level FROM persons))"""
_CENTS = "CAST(round(CAST({} AS DECIMAL(20,4)), 2) AS DOUBLE)"

#: ``more``: further columns.
SCORES = S.rstrip() + ",\n" + _REQUESTS + """,
inc AS (SELECT * FROM split WHERE split = 'train'),
qm AS (SELECT occupation, quantile_cont(ln(1 + annual_income), 0.1) AS a, quantile_cont(ln(1 + annual_income), 0.5) AS b,
              quantile_cont(ln(1 + annual_income), 0.9) AS c FROM inc GROUP BY 1),
qg AS (SELECT quantile_cont(ln(1 + annual_income), 0.1) AS a, quantile_cont(ln(1 + annual_income), 0.5) AS b,
              quantile_cont(ln(1 + annual_income), 0.9) AS c FROM inc),
pred AS (SELECT r.*, exp(coalesce(qm.a, qg.a)) - 1 AS p10, exp(coalesce(qm.b, qg.b)) - 1 AS p50,
                exp(coalesce(qm.c, qg.c)) - 1 AS p90 FROM requests r LEFT JOIN qm USING (occupation), qg),
cell AS (SELECT state, education_level, quantile_cont(annual_income, 0.5) AS md,
                avg(CAST(annual_income AS DECIMAL(38,10))) AS mn, count(*) AS n FROM inc GROUP BY 1, 2),
overall AS (SELECT quantile_cont(annual_income, 0.5) AS md, avg(CAST(annual_income AS DECIMAL(38,10))) AS mn FROM inc),
below AS (SELECT k.state, k.education_level, k.p50, count(i.annual_income) AS n
          FROM (SELECT DISTINCT state, education_level, p50 FROM pred) k
          LEFT JOIN inc i ON i.state = k.state AND i.education_level = k.education_level
                          AND i.annual_income < round(k.p50, 6) GROUP BY 1, 2, 3)
SELECT p.request_id, p.state, p.occupation, p.education_level, p.gender, p.age,
       round(p.p50, 2) AS predicted_salary, round(p.p10, 2) AS predicted_p10, round(p.p50, 2) AS predicted_p50,
       round(p.p90, 2) AS predicted_p90, round(p.p10, 2) AS prediction_interval_low,
       round(p.p90, 2) AS prediction_interval_high,
       CASE WHEN e.n IS NULL THEN 50.0 ELSE round(100.0 * b.n / e.n, 1) END AS percentile_in_group,
       """ + _CENTS.format("CASE WHEN e.n IS NULL THEN overall.md ELSE e.md END") + """ AS group_median,
       """ + _CENTS.format("CASE WHEN e.n IS NULL THEN overall.mn ELSE e.mn END") + """ AS group_mean,
       coalesce(e.n, 0) AS group_size, CAST(NULL AS DOUBLE) AS p_above_premium_threshold,
       CAST(NULL AS INTEGER) AS premium_threshold, p.p10 > p.p50 OR p.p50 > p.p90 AS quantiles_crossed{more}
FROM pred p JOIN below b USING (state, education_level, p50) LEFT JOIN cell e USING (state, education_level), overall"""

CROSSINGS = S.rstrip() + ",\n" + _REQUESTS + """
SELECT count(*) AS scored, CAST(0 AS BIGINT) AS crossings FROM requests"""

#: Views of the training rows (``inc``) and the valid requests.
SCORED_REQUESTS = S.rstrip() + ",\n" + _REQUESTS + """,
inc AS (SELECT * FROM split WHERE split = 'train')"""
