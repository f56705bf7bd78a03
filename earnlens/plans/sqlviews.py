"""SQL text of the test-table views, for the DuckDB oracles. Each oracle is
``WITH <views> SELECT ...`` over the pre-registered base tables."""

PERSONS = """persons AS (
  SELECT o.o_orderkey AS person_id, n.n_name AS state, r.r_name AS region,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Male' ELSE 'Female' END AS gender,
         CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) AS INTEGER) AS age,
         o.o_orderpriority AS education_level,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS education_ord,
         c.c_mktsegment AS occupation, o.o_totalprice AS annual_income
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE o.o_orderstatus IN ('F', 'O'))"""

WAGES = """wage_cells AS (
  SELECT c.c_mktsegment AS occupation, n.n_name AS state, count(*) AS n,
         avg(CAST(o.o_totalprice AS DECIMAL(38,10))) AS annual_mean_wage
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2),
wages AS (
  SELECT occupation, state, CAST(n AS DOUBLE) AS employment,
         1000.0 * n / sum(n) OVER (PARTITION BY state) AS jobs_per_1000,
         (n / sum(n) OVER (PARTITION BY state))
           / (sum(n) OVER (PARTITION BY occupation) / sum(n) OVER ()) AS location_quotient,
         annual_mean_wage, annual_mean_wage / 2080 AS hourly_mean
  FROM wage_cells)"""

COHORT = """cohort AS (
  SELECT DISTINCT p.occupation, p.state, p.person_id, p.region, p.gender, p.age,
         p.education_level, p.education_ord, p.annual_income,
         w.employment, w.jobs_per_1000, w.location_quotient, w.annual_mean_wage, w.hourly_mean
  FROM persons p JOIN wages w ON p.occupation = w.occupation AND p.state = w.state
  WHERE p.annual_income >= 100000)"""

BUCKET = """CASE WHEN substr(education_level, 1, 1) IN ('1', '2') THEN 'Advanced'
            WHEN substr(education_level, 1, 1) IN ('3', '4') THEN 'Bachelor'
            ELSE 'Lower' END"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


P = with_views(PERSONS)
PW = with_views(PERSONS, WAGES)
PWC = with_views(PERSONS, WAGES, COHORT)
