"""Statistics from sufficient statistics (STA-01..08, DST-01/02).

Each test is one distributed aggregate (n, mean, variance per group) and a
closed form on the resulting small table; p-values are pandas UDFs on that
table (one row per test or pair), never a collect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earnlens.functions.dist import f_pvalue, t_pvalue, tukey_pvalue
from earnlens.operators.joins import one_row
from earnlens.operators.ranking import exact_quantiles


def corr_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """STA-01: Pearson correlation of every column pair (a < b), long form,
    from one aggregate."""
    if len(cols) < 2:
        raise ValueError("need at least two numeric columns")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    a = df.agg(*[F.corr(x, y).alias(f"{x}__{y}") for x, y in pairs])
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"{x}__{y}").alias("corr"))
        for x, y in pairs])).alias("p")).select("p.*")


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """STA-02: least-squares line y = a + b x and its R2."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def group_stats(df: DataFrame, group: str, x: str) -> DataFrame:
    return df.where(F.col(group).isNotNull() & F.col(x).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.var_pop(x).alias("var_pop"))


def anova(df: DataFrame, group: str, x: str, with_p: bool = True) -> DataFrame:
    """STA-03: one-way ANOVA F = (SSB / (k-1)) / (SSW / (N-k)),
    SSW = sum n_g var_pop_g, SSB = sum n_g (mean_g - grand)^2."""
    g = group_stats(df, group, x)
    t = g.agg(F.sum("n").alias("n_total"), F.count("*").alias("k_groups"),
              (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
              F.sum(F.col("n") * F.col("var_pop")).alias("ssw"))
    j = g.withColumn("_k", F.lit(0)).join(one_row(t.withColumn("_k", F.lit(0))), "_k")
    r = j.groupBy("n_total", "k_groups", "ssw").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"))
    kk, nn = F.col("k_groups"), F.col("n_total")
    out = r.select(((F.col("ssb") / (kk - 1)) / (F.col("ssw") / (nn - kk))).alias("f_stat"),
                   (kk - 1).alias("df_between"), (nn - kk).alias("df_within"))
    if with_p:
        out = out.withColumn("p_value", f_pvalue("f_stat", F.col("df_between").cast("double"),
                                                 F.col("df_within").cast("double")))
        out = out.withColumn("significant", F.col("p_value") < 0.05)
    return out


def _two(df: DataFrame, group: str, a: str, b: str, x: str) -> DataFrame:
    g = group_stats(df.where(F.col(group).isin(a, b)), group, x)
    pick = lambda v, c: F.max(F.when(F.col(group) == v, F.col(c)))
    return g.agg(pick(a, "n").alias("n_a"), pick(a, "mean").alias("mean_a"),
                 pick(a, "var").alias("var_a"), pick(b, "n").alias("n_b"),
                 pick(b, "mean").alias("mean_b"), pick(b, "var").alias("var_b"))


def welch_t(df: DataFrame, group: str, a: str, b: str, x: str, with_p: bool = True) -> DataFrame:
    """STA-05: Welch's unequal-variance t and Welch-Satterthwaite df."""
    s = _two(df, group, a, b, x)
    ua, ub = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = s.select(((F.col("mean_a") - F.col("mean_b")) / F.sqrt(ua + ub)).alias("t_stat"),
                   (F.pow(ua + ub, 2) / (F.pow(ua, 2) / (F.col("n_a") - 1)
                                         + F.pow(ub, 2) / (F.col("n_b") - 1))).alias("df"),
                   (F.col("mean_a") - F.col("mean_b")).alias("gap"), "n_a", "n_b")
    if with_p:
        out = out.withColumn("p_value", t_pvalue("t_stat", "df"))
    return out


def cohens_d(df: DataFrame, group: str, a: str, b: str, x: str) -> DataFrame:
    """STA-06: d = (mean_a - mean_b) / sqrt((s_a^2 + s_b^2) / 2), sample
    variances; |d| < .5 small, < .8 medium, else large."""
    s = _two(df, group, a, b, x)
    d = (F.col("mean_a") - F.col("mean_b")) / F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    return s.select(d.alias("cohens_d")).withColumn(
        "effect", F.when(F.abs("cohens_d") < 0.5, "small")
        .when(F.abs("cohens_d") < 0.8, "medium").otherwise("large"))


def tukey_hsd(df: DataFrame, group: str, x: str, alpha: float = 0.05,
              with_p: bool = True) -> DataFrame:
    """STA-04: Tukey-Kramer pairs g1 < g2 over the k-row group table:
    meandiff = mean2 - mean1, se = sqrt(MSW / 2 (1/n1 + 1/n2)),
    q = |meandiff| / se; p-adj from the studentized range (k, N - k)."""
    g = group_stats(df, group, x)
    t = g.agg(F.sum("n").alias("n_total"), F.count("*").alias("k"),
              F.sum(F.col("n") * F.col("var_pop")).alias("ssw"))
    t = t.select("k", (F.col("n_total") - F.col("k")).alias("dfw"),
                 (F.col("ssw") / (F.col("n_total") - F.col("k"))).alias("msw"), F.lit(0).alias("_k"))
    g1 = g.select(F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"))
    g2 = g.select(F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    # pairs of *groups* (k(k-1)/2 rows of the aggregate), not of rows
    pairs = g1.join(g2, F.col("group1") < F.col("group2"))
    pairs = pairs.withColumn("_k", F.lit(0)).join(one_row(t), "_k").drop("_k")
    se = F.sqrt(F.col("msw") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = pairs.select("group1", "group2", (F.col("m2") - F.col("m1")).alias("meandiff"),
                       se.alias("se"), "k", "dfw")
    out = out.withColumn("q_stat", F.abs("meandiff") / F.col("se"))
    if with_p:
        out = out.withColumn("p_adj", tukey_pvalue("q_stat", F.col("k").cast("double"),
                                                   F.col("dfw").cast("double")))
        out = out.withColumn("reject", F.col("p_adj") < alpha)
    return out.drop("k", "dfw")


def jarque_bera(df: DataFrame, x: str) -> DataFrame:
    """STA-07 (re-aimed from Shapiro-Wilk on 200 rows to the full data):
    population skewness and excess kurtosis (Spark's stable one-pass
    central moments), JB = n/6 (S^2 + K^2/4), p = exp(-JB/2) (chi2, 2 df)."""
    a = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"),
               F.kurtosis(x).alias("excess_kurtosis"))
    jb = F.col("n") / 6.0 * (F.pow("skewness", 2) + F.pow("excess_kurtosis", 2) / 4.0)
    return a.withColumn("jb_stat", jb).withColumn("p_value", F.exp(-F.col("jb_stat") / 2.0))


def ks_normal(df: DataFrame, x: str) -> DataFrame:
    """STA-07: Kolmogorov-Smirnov against a normal fitted by mean and sd."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    m = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    r = KolmogorovSmirnovTest.test(df.select(F.col(x).cast("double").alias(x)), x, "norm",
                                   float(m["m"]), float(m["s"]))
    return r.select(F.col("statistic").alias("ks_stat"), F.col("pValue").alias("p_value"))


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """STA-08: variance inflation = diagonal of the inverse correlation
    matrix. The k x k matrix (k = number of features) is one distributed
    aggregate; the inversion is k x k work on the driver."""
    c = corr_long(df, cols).collect()
    k = len(cols)
    m = np.eye(k)
    idx = {n: i for i, n in enumerate(cols)}
    for r in c:
        i, j = idx[r["col_a"]], idx[r["col_b"]]
        m[i, j] = m[j, i] = r["corr"]
    inv = np.linalg.pinv(m)
    spark = df.sparkSession
    return spark.createDataFrame([(n, float(inv[i, i])) for n, i in idx.items()],
                                 "feature string, vif double")


def distribution(df: DataFrame, group: str, x: str) -> DataFrame:
    """DST-01: exact quantiles 0/5/25/50/75/95/100 % per category."""
    probs = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
    return exact_quantiles(df, [group], x, probs)


def histogram(df: DataFrame, x: str, bins: int = 60) -> DataFrame:
    """DST-02: equal-width bins between min and max (max falls in the last
    bin): bin = least(floor((x - min) / (max - min) * bins) + 1, bins)."""
    mm = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).withColumn("_k", F.lit(0))
    j = df.select(x).withColumn("_k", F.lit(0)).join(one_row(mm), "_k")
    b = F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1,
                F.lit(bins)).cast("int")
    h = j.where(F.col(x).isNotNull()).groupBy(b.alias("bin"), "_lo", "_hi").agg(
        F.count("*").alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return h.select("bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("_lo") + F.col("bin") * width).alias("bin_hi"), "n")
