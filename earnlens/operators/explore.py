"""Exploration aggregates (AGG-01..24, TOP-*, FLT-06/07).

Every operator is one declarative plan: partial + final hash aggregation,
then a top-k (TakeOrderedAndProject) or a window over the *aggregated*
table, whose size is bounded by key cardinality, never by rows. Top-k ties
are broken by the group key so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earnlens.functions.metrics import exact_mean
from earnlens.functions.text import education_bucket
from earnlens.operators.joins import lookup, semi, small
from earnlens.sources import dims

INCOME = "annual_income"
BUCKETS = ["Advanced", "Bachelor", "Lower"]


def _floor(df: DataFrame, floor, measure=INCOME) -> DataFrame:
    return df if floor is None else df.where(F.col(measure) >= floor)


def top_k(df: DataFrame, key: str, measure: str | None = None, agg: str = "avg",
          k: int = 10, ascending: bool = False, out: str | None = None) -> DataFrame:
    """TOP-01..04: aggregate ``measure`` by ``key`` and keep the k best.
    ``agg='count'`` ranks by row count. Ties -> key ascending.
    ``ascending=True`` is the ``tail(k)`` of an ascending sort (the same k
    rows as descending top-k; order is presentation only)."""
    if agg == "count":
        g = df.groupBy(key).agg(F.count("*").alias(out or "n"))
        val = out or "n"
    else:
        fn = {"avg": exact_mean, "sum": F.sum, "max": F.max, "min": F.min}[agg]
        val = out or f"{agg}_{measure}"
        g = df.groupBy(key).agg(fn(measure).alias(val), F.count("*").alias("n"))
    return g.orderBy(F.col(val).desc(), F.col(key).asc()).limit(k)


def top_groups_by_mean(df: DataFrame, group: str = "occupation", measure: str = INCOME,
                       k: int = 10, floor=dims.MIN_ANNUAL_INCOME) -> DataFrame:
    """AGG-01: mean income by group among incomes >= floor, k highest."""
    return top_k(_floor(df, floor, measure), group, measure, "avg", k, out="mean_income")


def mean_by_level_ordered(df: DataFrame, level_dim: DataFrame, level: str = "education_level",
                          ordinal: str = "education_ord", measure: str = INCOME) -> DataFrame:
    """AGG-02/AGG-22: mean and n per level, in dimension order; a level with
    no rows is kept with a null mean and n = 0."""
    agg = df.groupBy(level).agg(exact_mean(measure).alias("mean_income"), F.count("*").alias("n"))
    return (level_dim.join(agg, level, "left")
            .select(level, ordinal, "mean_income", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy(ordinal))


def restrict_to_top(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """FLT-07: rows whose ``key`` is among the k most frequent (semi join
    against a k-row broadcast)."""
    top = top_k(df, key, agg="count", k=k).select(key)
    return semi(df, top, key)


def counts_within_top(df: DataFrame, key: str, by: str = "gender", k: int = 10) -> DataFrame:
    """AGG-03/04: counts by (key, by) within the k most frequent keys."""
    return restrict_to_top(df, key, k).groupBy(key, by).agg(F.count("*").alias("n"))


def counts_by(df: DataFrame, keys: list[str], floor=None, measure: str = INCOME) -> DataFrame:
    """AGG-05 and friends: row counts by keys (after an optional floor)."""
    return _floor(df, floor, measure).groupBy(*keys).agg(F.count("*").alias("n"))


def dominant_level(df: DataFrame, group: str = "state", level: str = "education_level",
                   floor=dims.MIN_ANNUAL_INCOME, measure: str = INCOME) -> DataFrame:
    """AGG-11: modal level per group; ties -> smallest label."""
    c = counts_by(df, [group, level], floor, measure)
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(level).asc())
    return (c.withColumn("rk", F.row_number().over(w)).where("rk = 1")
            .select(group, F.col(level).alias("dominant_level"), "n"))


def dominant_level_counts(df: DataFrame, **kw) -> DataFrame:
    """AGG-11 (second half): number of groups per dominant level."""
    return dominant_level(df, **kw).groupBy("dominant_level").agg(F.count("*").alias("n_groups"))


def bucket_means(df: DataFrame, group: str = "state", bucket: Column | None = None,
                 measure: str = INCOME, floor=dims.MIN_ANNUAL_INCOME) -> DataFrame:
    """Mean measure per group and education bucket, pivoted with explicit
    values (one aggregate, no value-discovery job)."""
    b = bucket if bucket is not None else education_bucket("education_level")
    d = _floor(df, floor, measure).withColumn("_bucket", b)
    p = d.groupBy(group).pivot("_bucket", BUCKETS).agg(exact_mean(measure))
    return p.select(group, *[F.col(x).alias(f"{x.lower()}_mean") for x in BUCKETS])


def education_premium(df: DataFrame, group: str = "state", bucket: Column | None = None,
                      measure: str = INCOME, floor=dims.MIN_ANNUAL_INCOME,
                      k: int | None = 20) -> DataFrame:
    """AGG-12: Advanced mean - max(Bachelor, Lower) (null-skipping), rows
    with a null premium dropped, k largest."""
    p = bucket_means(df, group, bucket, measure, floor)
    p = p.withColumn("premium", F.col("advanced_mean")
                     - F.greatest("bachelor_mean", "lower_mean")).where(F.col("premium").isNotNull())
    if k is not None:
        p = p.orderBy(F.col("premium").desc(), F.col(group).asc()).limit(k)
    return p


def premium_vs_market_size(df: DataFrame, group: str = "state", bucket: Column | None = None,
                           measure: str = INCOME, floor=dims.MIN_ANNUAL_INCOME) -> DataFrame:
    """AGG-13/JOIN-06: premium joined with rows per group (both are small
    per-group aggregates; the full-outer-then-dropna of the reference is an
    inner join)."""
    p = education_premium(df, group, bucket, measure, floor, k=None)
    m = counts_by(df, [group], floor, measure).withColumnRenamed("n", "market_size")
    return p.select(group, "premium").join(m, group, "inner")


def group_summary(df: DataFrame, group: str, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(group).agg(*[c.alias(n) for n, c in measures.items()])


def region_income(df: DataFrame, region: str = "region", measure: str = INCOME) -> DataFrame:
    """AGG-14."""
    return group_summary(df, region, {"mean_income": exact_mean(measure), "n": F.count("*")})


def region_share(df: DataFrame, region: str = "region") -> DataFrame:
    """AGG-15: rows per region / all mapped rows (window over the
    aggregate, one row per region)."""
    c = df.where(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def region_describe(df: DataFrame, region: str = "region", measure: str = INCOME) -> DataFrame:
    """AGG-17: mean, exact median (distributed selection), sample std."""
    from earnlens.operators.ranking import exact_median
    s = group_summary(df, region, {"mean_income": exact_mean(measure),
                                   "std_income": F.stddev_samp(measure), "n": F.count("*")})
    med = exact_median(df, [region], measure, "median_income")
    return s.join(med, region, "left").select(region, "mean_income", "median_income",
                                              "std_income", "n")


def state_summary(df: DataFrame, state: str = "state", measure: str = INCOME,
                  lq: str = "location_quotient") -> DataFrame:
    """AGG-16: mean income, count and mean location quotient per state."""
    return group_summary(df, state, {"mean_income": exact_mean(measure), "n": F.count("*"),
                                     "mean_lq": exact_mean(lq)})


def headline_tiles(df: DataFrame, state: str = "state", occupation: str = "occupation",
                   measure: str = INCOME) -> DataFrame:
    """AGG-18: rows, mean income, most frequent state and occupation (ties
    -> smallest name), as one row.

    One grouping-sets aggregate over (state), (occupation), () and a second
    tiny aggregate that folds its rows; no joins."""
    g = (df.groupingSets([[state], [occupation], []], state, occupation)
         .agg(F.count("*").alias("n"), F.sum(F.col(measure).cast("decimal(38,10)")).alias("s"),
              F.grouping_id().alias("gid")))
    best = lambda gid, key: F.min(F.when(F.col("gid") == gid, F.struct(
        (-F.col("n")).alias("neg_n"), F.col(key).alias("v")))).getField("v")
    return g.agg(
        F.max(F.when(F.col("gid") == 3, F.col("n"))).alias("rows"),
        F.max(F.when(F.col("gid") == 3, F.col("s") / F.col("n"))).cast("double").alias("mean_income"),
        best(1, state).alias("top_state"),
        best(2, occupation).alias("top_occupation"),
    )


def filter_cohort(df: DataFrame, regions=None, levels=None, lo=None, hi=None,
                  region: str = "region", level: str = "education_level",
                  measure: str = INCOME) -> DataFrame:
    """FLT-06: region in set, level in set, measure between lo and hi
    (inclusive). None means 'no restriction'."""
    cond = F.lit(True)
    if regions is not None:
        cond = cond & F.col(region).isin(list(regions))
    if levels is not None:
        cond = cond & F.col(level).isin(list(levels))
    if lo is not None:
        cond = cond & (F.col(measure) >= lo)
    if hi is not None:
        cond = cond & (F.col(measure) <= hi)
    return df.where(cond)


def gender_share(df: DataFrame, group: str = "state", gender: str = "gender") -> DataFrame:
    """AGG-19: percent of rows per group that are Male / Female."""
    return df.groupBy(group).agg(
        (F.avg((F.col(gender) == "Male").cast("double")) * 100).alias("male_pct"),
        (F.avg((F.col(gender) == "Female").cast("double")) * 100).alias("female_pct"),
        F.count("*").alias("n"))


def leading_by_group(df: DataFrame, group: str = "state", item: str = "occupation") -> DataFrame:
    """AGG-20: the most frequent ``item`` per group (ties -> smallest)."""
    c = df.groupBy(group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(item).asc())
    return c.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def group_size_dilution(df: DataFrame, keys=("occupation", "state")) -> DataFrame:
    """AGG-21: sizes of the (occupation, state) groups: median, min, max and
    dilution = 100 / median."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("n_groups"),
                 F.percentile("n", 0.5).alias("median_size"),
                 F.min("n").alias("min_size"), F.max("n").alias("max_size")
                 ).withColumn("dilution_pct", 100.0 / F.col("median_size"))


def within_group_gap(df: DataFrame, group: str = "occupation", gender: str = "gender",
                     measure: str = INCOME) -> DataFrame:
    """AGG-23: mean by (group, gender) pivoted; groups lacking either gender
    dropped; gap in money and in % of the female mean."""
    p = df.groupBy(group).pivot(gender, ["Male", "Female"]).agg(exact_mean(measure))
    p = p.select(group, F.col("Male").alias("male_mean"), F.col("Female").alias("female_mean"))
    p = p.dropna(subset=["male_mean", "female_mean"])
    return p.withColumns({"gap": F.col("male_mean") - F.col("female_mean"),
                          "gap_pct": (F.col("male_mean") - F.col("female_mean"))
                          / F.col("female_mean") * 100})


def gap_summary(df: DataFrame, **kw) -> DataFrame:
    """AGG-23 summary: groups, median gap ($ and %), share where men earn more."""
    g = within_group_gap(df, **kw)
    return g.agg(F.count("*").alias("n_groups"),
                 F.percentile("gap", 0.5).alias("median_gap"),
                 F.percentile("gap_pct", 0.5).alias("median_gap_pct"),
                 F.avg((F.col("gap") > 0).cast("double")).alias("share_male_higher"))


def valid_values(df: DataFrame, cols=("state", "occupation", "education_level")) -> DataFrame:
    """AGG-24: the catalogue of valid values, long form (kind, value)."""
    parts = [df.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")).distinct()
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("kind", "value")


def distinct_count(df: DataFrame, col: str = "state", exact: bool = True) -> DataFrame:
    """AGG-24: number of distinct values (approx at scale when asked)."""
    f = F.countDistinct(col) if exact else F.approx_count_distinct(col)
    return df.agg(f.alias(f"n_distinct_{col}"))


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None,
            tail: bool = False) -> DataFrame:
    """TOP-05: head(n) / tail(n). Spark rows have no order of their own, so
    a tail needs explicit order columns (a top-k on the reversed order)."""
    if order is None:
        if tail:
            raise ValueError("tail needs order columns")
        return df.limit(n)
    cols = [F.col(c).desc() if tail else F.col(c).asc() for c in order]
    out = df.orderBy(*cols).limit(n)
    return out.orderBy(*order) if tail else out


def region_by_name(df: DataFrame, abbreviations: DataFrame, regions: DataFrame,
                   state: str = "state") -> DataFrame:
    """PRJ-13: state name -> ``abbreviation`` -> ``region_name`` by two lookups;
    an unknown name or abbreviation gives null. ``abbreviations``: (state,
    abbreviation); ``regions``: (abbreviation, region_name)."""
    return lookup(lookup(df, abbreviations, state), regions, "abbreviation")
