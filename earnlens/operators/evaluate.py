"""Model evaluation, subgroup fairness and metric bands (EVA-01..17,
FAI-01, MOD-08). Every metric is one aggregate over the scored frame;
ranking metrics use the distributed prefix counts (no global sort task)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earnlens.functions.metrics import crossed, pinball
from earnlens.operators.ranking import G0, distinct_prefix, exact_quantiles


def point_metrics(df: DataFrame, y: str = "annual_income", yhat: str = "p50",
                  groups=None) -> DataFrame:
    """EVA-01/EVA-16: R2 = 1 - SSE / SST, MAE, RMSE (and n) per group."""
    e = F.col(y) - F.col(yhat)
    g = df.groupBy(*(groups or []))
    return g.agg(
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.count("*").alias("n"))


def pinball_losses(df: DataFrame, y: str = "annual_income",
                   heads: dict[float, str] | None = None) -> DataFrame:
    """EVA-02: mean pinball loss per quantile head."""
    heads = heads or {0.1: "p10", 0.5: "p50", 0.9: "p90"}
    return df.agg(*[F.avg(pinball(y, c, a)).alias(f"pinball_{c}") for a, c in heads.items()])


def interval_metrics(df: DataFrame, y: str = "annual_income", lo: str = "p10",
                     mid: str = "p50", hi: str = "p90") -> DataFrame:
    """EVA-03/04/05: inclusive 80 % coverage, exact median width,
    crossings counted before any clamping."""
    a = df.agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
               F.count_if(crossed(lo, mid, hi)).alias("crossings"),
               F.count("*").alias("n"), F.lit(0).alias("_k"))
    w = exact_quantiles(df.select((F.col(hi) - F.col(lo)).alias("_w")), [], "_w",
                        {"median_width": 0.5}).withColumn("_k", F.lit(0))
    return a.join(w, "_k", "left").select("coverage", "median_width", "crossings", "n")


def _stack(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per (row, attribute): attribute name and its value as text."""
    return df.withColumn("_sg", F.explode(F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("grp"))
        for c in by]))).select("*", "_sg.attribute", "_sg.grp").drop("_sg")


def subgroup_coverage(df: DataFrame, by=("gender", "region"), y: str = "annual_income",
                      lo: str = "p10", hi: str = "p90", min_n: int = 30) -> DataFrame:
    """EVA-06: coverage per subgroup value with n >= min_n."""
    s = _stack(df, list(by)).where(F.col("grp").isNotNull())
    return (s.groupBy("attribute", "grp")
            .agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
                 F.count("*").alias("n"))
            .where(F.col("n") >= min_n))


def subgroup_point_metrics(df: DataFrame, by=("gender", "region"), y="annual_income",
                           yhat="p50", min_n: int = 30) -> DataFrame:
    """EVA-16: R2 / MAE / n per subgroup value."""
    s = _stack(df, list(by)).where(F.col("grp").isNotNull())
    return point_metrics(s, y, yhat, ["attribute", "grp"]).where(F.col("n") >= min_n)


def _score_counts(df: DataFrame, label: str, score: str, groups) -> DataFrame:
    return distinct_prefix(df, groups, score, {
        "pos": F.col(label).cast("bigint"), "neg": (1 - F.col(label)).cast("bigint")})


def roc_auc(df: DataFrame, label: str = "premium", score: str = "score",
            groups=None) -> DataFrame:
    """EVA-07/EVA-11: exact ROC-AUC with ties counted half:
    sum over distinct scores of pos * (neg strictly below + neg here / 2),
    divided by P * N. Groups with a single class give null."""
    groups = list(groups or [])
    dv = _score_counts(df, label, score, groups)
    gk = groups or [G0]
    a = dv.groupBy(*gk).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    a = a.select(*gk, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                 "n_pos", "n_neg")
    return a.drop(G0) if not groups else a


def average_precision(df: DataFrame, label: str = "premium", score: str = "score",
                      groups=None) -> DataFrame:
    """EVA-08: step-wise AP = sum over distinct thresholds (descending) of
    (recall gain) x precision, with TP(>=t) = P - pos below t and
    FP(>=t) = N - neg below t. Not the interpolated area."""
    groups = list(groups or [])
    gk = groups or [G0]
    dv = _score_counts(df, label, score, groups)
    tot = dv.groupBy(*gk).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = dv.join(tot, gk)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    a = j.groupBy(*gk).agg(F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P") * tp / (tp + fp))
                                 ).alias("average_precision"))
    return a.drop(G0) if not groups else a


def threshold_metrics(df: DataFrame, label: str = "premium", score: str = "score",
                      t: float = 0.5) -> DataFrame:
    """EVA-09: accuracy, precision, recall, F1 at ``score >= t``; a zero
    denominator gives 0."""
    pred = F.col(score) >= t
    pos = F.col(label) == 1
    a = df.agg(F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
               F.count_if(~pred & pos).alias("fn"), F.count_if(~pred & ~pos).alias("tn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    a = a.withColumns({"precision": p, "recall": r})
    return a.select(
        ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
         ).alias("accuracy"), "precision", "recall",
        F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
               ).otherwise(0.0).alias("f1"), "tp", "fp", "fn", "tn")


def brier(df: DataFrame, label: str = "premium", score: str = "score",
          base_rate: float | Column | None = None) -> DataFrame:
    """EVA-10: Brier score of the model and of the constant base-rate
    predictor (the frame's own positive rate unless given)."""
    a = df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"),
               F.avg(label).alias("rate"), F.avg(F.col(label) * F.col(label)).alias("m2"))
    r = F.col("rate") if base_rate is None else F.lit(base_rate)
    # mean((r - y)^2) = r^2 - 2 r mean(y) + mean(y^2)
    return a.select("brier", (r * r - 2 * r * F.col("rate") + F.col("m2")).alias("brier_base_rate"))


def positive_rate(df: DataFrame, label: str = "premium", split: str | None = None) -> DataFrame:
    """EVA-14/MOD-08: positive rate (per split) and majority-class accuracy."""
    g = df.groupBy(split) if split else df.groupBy()
    a = g.agg(F.avg(label).alias("positive_rate"), F.count("*").alias("n"))
    return a.withColumn("majority_accuracy", F.greatest("positive_rate", 1 - F.col("positive_rate")))


def demographic_parity(df: DataFrame, by: str = "gender", pred: str = "p50") -> DataFrame:
    """FAI-01: mean prediction per group and the max - min gap (window over
    the per-group aggregate)."""
    from pyspark.sql import Window
    a = df.groupBy(by).agg(F.avg(pred).alias("mean_prediction"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    return a.withColumn("parity_gap", F.max("mean_prediction").over(w)
                        - F.min("mean_prediction").over(w))


def residual_summary(df: DataFrame, y: str = "annual_income", yhat: str = "p50") -> DataFrame:
    """EVA-15: residual mean, sample std, min, max, n."""
    e = F.col(y) - F.col(yhat)
    return df.agg(F.avg(e).alias("mean_residual"), F.stddev_samp(e).alias("std_residual"),
                  F.min(e).alias("min_residual"), F.max(e).alias("max_residual"),
                  F.count("*").alias("n"))


def residual_pairs(df: DataFrame, key: str, y: str = "annual_income", yhat: str = "p50") -> DataFrame:
    """EVA-15: actual, predicted and residual of each row."""
    return df.select(key, F.col(y).alias("actual"), F.col(yhat).alias("predicted"),
                     (F.col(y) - F.col(yhat)).alias("residual"))


# Metric bands (fixed values of the reference's guard tests).
BANDS = [
    ("coverage_80", 0.72, 0.88),
    ("crossings", 0.0, 0.0),
    ("r2", 0.0, 0.4),
    ("mae", 30000.0, 90000.0),
    ("rmse", 60000.0, 160000.0),
    ("cv_test_gap", 0.0, 0.15),
    ("subgroup_coverage", 0.60, 0.95),
    ("roc_auc", 0.55, 0.99),
    ("subgroup_roc_auc", 0.50, 0.95),
]


# Bounds that a value must not touch.
STRICT_LOW, STRICT_HIGH = {"subgroup_roc_auc"}, {"roc_auc", "subgroup_roc_auc"}


def band_values(scored: DataFrame, cv: DataFrame, classes: DataFrame, subgroup_auc: DataFrame) -> DataFrame:
    """The nine banded metrics as long rows ``metric, grp, value``; ``grp`` is
    null but for subgroups. ``scored``: heads in dollars; ``cv``: one row with
    ``cv_r2_mean``; ``classes``: classifier scores; ``subgroup_auc``:
    ``attribute, grp, roc_auc``."""
    one = interval_metrics(scored).select("coverage", "crossings", F.lit(0).alias("_k"))
    for f in (point_metrics(scored).select("r2", "mae", "rmse"), cv.select("cv_r2_mean"), roc_auc(classes).select("roc_auc")):
        one = one.join(f.withColumn("_k", F.lit(0)), "_k")
    values = {"coverage_80": F.col("coverage"), "crossings": F.col("crossings").cast("double"), "r2": F.col("r2"), "mae": F.col("mae"),
              "rmse": F.col("rmse"), "cv_test_gap": F.abs(F.col("cv_r2_mean") - F.col("r2")), "roc_auc": F.col("roc_auc")}
    none = F.lit(None).cast("string").alias("grp")
    head = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), none, v.alias("value")) for m, v in values.items()])).alias("r"))
    group = F.concat_ws("=", "attribute", "grp").alias("grp")
    return head.select("r.*").unionByName(
        subgroup_coverage(scored).select(F.lit("subgroup_coverage").alias("metric"), group, F.col("coverage").alias("value"))).unionByName(
        subgroup_auc.select(F.lit("subgroup_roc_auc").alias("metric"), group, F.col("roc_auc").alias("value")))


def metric_bands(metrics: DataFrame, bands=BANDS) -> DataFrame:
    """EVA-17: ``metrics`` is long (metric, value); each value is checked
    against its band, inclusive but for the strict bounds -> (metric, value, lo, hi, passed). Subgroup
    metrics may appear many times. The band table is fixed-size."""
    spark = metrics.sparkSession
    b = spark.createDataFrame(bands, "metric string, lo double, hi double")
    j = metrics.join(F.broadcast(b), "metric", "inner")
    touches = (F.col("metric").isin(*STRICT_LOW) & (F.col("value") == F.col("lo"))) | (
        F.col("metric").isin(*STRICT_HIGH) & (F.col("value") == F.col("hi")))
    return j.withColumn("passed", F.col("value").between(F.col("lo"), F.col("hi")) & ~touches)
