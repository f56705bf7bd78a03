"""Profiling and data-quality expectations (PRF-01..05, DQ-01..07, DQ-12).

Every profile is a single aggregate over the table (one pass) reshaped to
long form with ``explode(array(struct ...))``; expectations return
(rule, passed, observed) rows instead of raising, so a whole report is one
job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.operators.ranking import exact_quantiles_long


def _long(a: DataFrame, items: list[tuple[str, dict]]) -> DataFrame:
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("column"), *[c.alias(k) for k, c in vals.items()])
        for name, vals in items])).alias("r")).select("r.*")


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """PRF-01: nulls per column (NaN counts as null for doubles)."""
    cols = cols or df.columns
    dt = dict(df.dtypes)
    isnull = lambda c: (F.col(c).isNull() | F.isnan(c)) if dt[c] in ("double", "float") \
        else F.col(c).isNull()
    a = df.agg(*[F.count_if(isnull(c)).alias(c) for c in cols])
    return _long(a, [(c, {"nulls": F.col(c)}) for c in cols])


def distinct_profile(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """PRF-04: distinct values per column (``approx_count_distinct`` -- an
    HLL++ sketch -- when ``exact`` is False, for very large tables)."""
    cols = cols or df.columns
    f = F.countDistinct if exact else F.approx_count_distinct
    a = df.agg(*[f(c).alias(c) for c in cols])
    return _long(a, [(c, {"n_distinct": F.col(c)}) for c in cols])


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRF-02: count, mean, sample std, min, exact 25/50/75 % (linear
    interpolation), max per numeric column, long form. Moments in one
    aggregate; all quartiles in one stacked ranking pass."""
    a = df.agg(*[x for c in cols for x in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
        F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
        F.max(c).cast("double").alias(f"{c}__max"))])
    mom = _long(a, [(c, {k: F.col(f"{c}__{k}") for k in ("count", "mean", "std", "min", "max")})
                    for c in cols])
    q = exact_quantiles_long(df, [], cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    q = q.withColumnRenamed("measure", "column")
    return mom.join(q, "column", "left").select("column", "count", "mean", "std", "min",
                                                "p25", "p50", "p75", "max")


def shape(df: DataFrame) -> DataFrame:
    """PRF-03: rows, columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def expectations(df: DataFrame, *, not_null=(), row_range=None, distinct_eq=None,
                 min_floor=None, positive=(), in_range=None, in_set=None) -> DataFrame:
    """DQ-02..07 as one aggregate -> (rule, passed, observed).

    not_null: columns with no nulls; row_range: (lo, hi); distinct_eq:
    (col, n); min_floor: (col, floor); positive: columns all > 0;
    in_range: {col: (lo, hi)}; in_set: {col: values}."""
    aggs, rules = expectation_rules(not_null=not_null, row_range=row_range, distinct_eq=distinct_eq, min_floor=min_floor,
                                    positive=positive, in_range=in_range, in_set=in_set)
    return judge(df.agg(*aggs), rules)


def judge(metrics: DataFrame, rules) -> DataFrame:
    """One row of the rules' metrics -> (rule, passed, observed)."""
    return metrics.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), p.alias("passed"), o.cast("double").alias("observed"))
        for n, p, o in rules])).alias("r")).select("r.*")


def expectation_rules(*, not_null=(), row_range=None, distinct_eq=None, min_floor=None, positive=(), in_range=None, in_set=None):
    """The rules of :func:`expectations` as (aggregates, rules over them). The
    aggregates can also be observed while a table is written; the distinct
    count therefore gathers the values, so it is for columns of few ones."""
    aggs, rules = [], []
    for c in not_null:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"nn_{c}"))
        rules.append((f"not_null:{c}", F.col(f"nn_{c}") == 0, F.col(f"nn_{c}")))
    if row_range:
        aggs.append(F.count("*").alias("rows"))
        rules.append(("row_count_in_range", F.col("rows").between(*row_range), F.col("rows")))
    if distinct_eq:
        c, n = distinct_eq
        aggs.append(F.size(F.collect_set(c)).alias(f"dc_{c}"))
        rules.append((f"distinct:{c}=={n}", F.col(f"dc_{c}") == n, F.col(f"dc_{c}")))
    if min_floor:
        c, fl = min_floor
        aggs.append(F.min(c).alias(f"mn_{c}"))
        rules.append((f"min:{c}>={fl}", F.col(f"mn_{c}") >= fl, F.col(f"mn_{c}")))
    for c in positive:
        aggs.append(F.count_if(~(F.col(c) > 0)).alias(f"np_{c}"))
        rules.append((f"positive:{c}", F.col(f"np_{c}") == 0, F.col(f"np_{c}")))
    for c, (lo, hi) in (in_range or {}).items():
        aggs.append(F.count_if(~F.col(c).between(lo, hi)).alias(f"or_{c}"))
        rules.append((f"range:{c}", F.col(f"or_{c}") == 0, F.col(f"or_{c}")))
    for c, vals in (in_set or {}).items():
        aggs.append(F.count_if(~F.col(c).isin(list(vals))).alias(f"os_{c}"))
        rules.append((f"in_set:{c}", F.col(f"os_{c}") == 0, F.col(f"os_{c}")))
    return aggs, rules


def threshold_consistency(annual: float, hourly: float, hours: int = 2080,
                          tol: float = 0.01) -> bool:
    """DQ-12: the hourly floor equals annual / hours within ``tol``."""
    return abs(hourly - annual / hours) <= tol


def threshold_checks(wages: DataFrame, labelled: DataFrame, annual: float, hourly: float,
                     threshold: float, hours: int = 2080, tol: float = 0.01, label: str = "premium",
                     income: str = "annual_income") -> DataFrame:
    """DQ-12 -> (rule, passed, observed): the two wage floors agree, every wage
    row's hourly mean is its annual mean over ``hours`` and every label is
    income >= ``threshold``, the one that is served."""
    off = F.abs(F.col("hourly_mean") - F.col("annual_mean_wage") / hours) > tol
    w = wages.agg(F.count_if(off).cast("double").alias("observed")).select(
        F.lit("wage_rows_agree").alias("rule"), (F.col("observed") == 0).alias("passed"), "observed",
        F.lit(abs(hourly - annual / hours)).alias("_gap"))
    w = w.select(F.explode(F.array(
        F.struct("rule", "passed", "observed"),
        F.struct(F.lit("floors_agree").alias("rule"), F.lit(threshold_consistency(annual, hourly, hours, tol)).alias(
            "passed"), F.col("_gap").alias("observed")))).alias("r")).select("r.*")
    wrong = F.col(label).cast("int") != (F.col(income) >= threshold).cast("int")
    lab = labelled.agg(F.count_if(wrong).cast("double").alias("observed")).select(
        F.lit("labels_match_threshold").alias("rule"), (F.col("observed") == 0).alias("passed"), "observed")
    return w.unionByName(lab)
