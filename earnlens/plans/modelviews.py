"""Scored frames for the evaluation queries, built with closed-form models so
SQL can reproduce them: a per-occupation quantile model (p10/p50/p90 of the
train split) and a per-(state, education) premium-rate classifier score.
The fitted Spark ML models are evaluated by the same operators in
``modeling`` (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from earnlens.operators.features import hash_split
from earnlens.operators.joins import one_row
from earnlens.operators.ranking import exact_quantiles
from earnlens.plans.sqlviews import COHORT, PERSONS, WAGES, with_views
from earnlens.sources import dims
from earnlens.sources import testbed as tb

T = dims.TESTBED_PREMIUM_THRESHOLD


def split_cohort(spark, sf):
    return hash_split(tb.cohort(spark, sf), "person_id", 0.2, 42)


def quantile_scored(spark, sf):
    s = split_cohort(spark, sf)
    train = s.where("split = 'train'")
    q = exact_quantiles(train, ["occupation"], "annual_income",
                        {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return s.where("split = 'test'").join(q, "occupation")


def class_scored(spark, sf):
    s = split_cohort(spark, sf).withColumn(
        "premium", (F.col("annual_income") >= T).cast("int"))
    train = s.where("split = 'train'")
    cell = train.groupBy("state", "education_level").agg(F.avg("premium").alias("_cell"))
    rate = train.agg(F.avg("premium").alias("_rate")).withColumn("_k", F.lit(0))
    test = s.where("split = 'test'").join(cell, ["state", "education_level"], "left")
    test = test.withColumn("_k", F.lit(0)).join(one_row(rate), "_k").drop("_k")
    return test.withColumn("score", F.coalesce("_cell", "_rate")).drop("_cell", "_rate")


SPLIT_SQL = """split AS (
  SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(person_id AS VARCHAR) || '|42'), 1, 8))
                           AS UBIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split
  FROM cohort)"""
QSCORED_SQL = """qmodel AS (
  SELECT occupation, quantile_cont(annual_income, 0.1) AS p10,
         quantile_cont(annual_income, 0.5) AS p50, quantile_cont(annual_income, 0.9) AS p90
  FROM split WHERE split = 'train' GROUP BY 1),
scored AS (SELECT s.*, q.p10, q.p50, q.p90 FROM split s JOIN qmodel q USING (occupation)
           WHERE s.split = 'test')"""
CSCORED_SQL = f"""lab AS (SELECT *, CASE WHEN annual_income >= {T} THEN 1 ELSE 0 END AS premium
         FROM split),
cmodel AS (SELECT state, education_level, avg(premium) AS score FROM lab
           WHERE split = 'train' GROUP BY 1, 2),
cscored AS (
  SELECT l.*, coalesce(c.score, (SELECT avg(premium) FROM lab WHERE split = 'train')) AS score
  FROM lab l LEFT JOIN cmodel c USING (state, education_level) WHERE l.split = 'test')"""

S = with_views(PERSONS, WAGES, COHORT, SPLIT_SQL)
Q = with_views(PERSONS, WAGES, COHORT, SPLIT_SQL, QSCORED_SQL)
C = with_views(PERSONS, WAGES, COHORT, SPLIT_SQL, CSCORED_SQL)
