"""Queries on fitted heads: the quantile forest and the premium classifier
(MOD-01, EVA-12/13/17/18, EXP-01..04, SCO-02/03/05), and the feature sets (FEA-09, MOD-05).

Fits have no SQL form; the forest's quantile step and the point model do, on
leaves and predictions that SQL can make itself.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.modeling import explain as xp
from earnlens.modeling import train as tr
from earnlens.modeling.quantile_forest import QuantileForest, co_member_quantiles, leaf_labels, leaf_ranges
from earnlens.operators import evaluate as ev
from earnlens.operators import features as fe
from earnlens.operators.provenance import fingerprint, model_version
from earnlens.operators.score import GroupQuantileModel, PointModel, score
from earnlens.plans.ml_queries import _memo, artefacts, engineered, kept_as, premium_model, premium_scored, valid_requests
from earnlens.plans.modelviews import S, split_cohort
from earnlens.plans.registry import query, r4
from earnlens.plans.scoring_sql import SCORES
from earnlens.session import materialize, written
from earnlens.sources import dims
from earnlens.sources import testbed as tb
from earnlens.sources.store import processed

T = dims.TESTBED_PREMIUM_THRESHOLD
SEEDS = (11, 22, 33, 44, 55)
FOLDS = 5


class InDollars:
    """A fitted model with its heads in dollars: ``p10, p50, p90``."""

    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumns({f"p{n}": F.expm1(f"q{n}") for n in (10, 50, 90)})


def fit_heads(train: DataFrame, seed: int = 42) -> InDollars:
    return InDollars(QuantileForest(fe.FEATURES_FULL, seed=seed).fit(train))


def served_trees(spark, sf):
    """The trees behind the served heads; they predict the mean label."""
    return _memo(spark, sf, "forest-trees", lambda: QuantileForest(fe.FEATURES_FULL).fit_trees(engineered(spark, sf)[0]))


def forest_model(spark, sf) -> InDollars:
    return _memo(spark, sf, "quantile-forest", lambda: InDollars(
        QuantileForest(fe.FEATURES_FULL).fit(engineered(spark, sf)[0], served_trees(spark, sf))))


def forest_scored(spark, sf) -> DataFrame:
    return processed(spark, "forest-scored", sf, lambda: forest_model(spark, sf).transform(engineered(spark, sf)[1]))


def one_row_of(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("_k", F.lit(0))
    for f in frames[1:]:
        out = out.join(f.withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


@query("quantile_forest")
def q_forest(spark, sf):
    """Test metrics of the quantile forest, and the pinball losses of the train split's constant quantiles."""
    sc = forest_scored(spark, sf)
    train = engineered(spark, sf)[0]
    constant = train.agg(*[F.percentile("annual_income", a).alias(f"c{n}") for a, n in ((0.1, 10), (0.5, 50), (0.9, 90))])
    base = ev.pinball_losses(sc.select("annual_income").join(F.broadcast(constant)), heads={0.1: "c10", 0.5: "c50", 0.9: "c90"})
    return r4(one_row_of(ev.interval_metrics(sc), ev.pinball_losses(sc), base, ev.point_metrics(sc).select("r2", "mae", "rmse")))


_LEAVES = ["occupation", "state", "education_level"]


@query("leaf_quantiles", S + """,
k AS (SELECT DISTINCT occupation, state, education_level FROM split WHERE split = 'test'),
tr AS (SELECT *, count(*) OVER (PARTITION BY occupation) AS n0, count(*) OVER (PARTITION BY state) AS n1,
              count(*) OVER (PARTITION BY education_level) AS n2 FROM split WHERE split = 'train'),
w AS (SELECT k.*, t.annual_income AS v, 1.0 / t.n0 AS w FROM k JOIN tr t ON t.occupation = k.occupation
      UNION ALL SELECT k.*, t.annual_income, 1.0 / t.n1 FROM k JOIN tr t ON t.state = k.state
      UNION ALL SELECT k.*, t.annual_income, 1.0 / t.n2 FROM k JOIN tr t ON t.education_level = k.education_level),
d AS (SELECT occupation, state, education_level, v, sum(CAST(w AS DOUBLE)) AS w FROM w GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(w) OVER (PARTITION BY occupation, state, education_level ORDER BY v) AS upto,
             sum(w) OVER (PARTITION BY occupation, state, education_level) AS total FROM d)
SELECT occupation, state, education_level, min(v) FILTER (WHERE upto >= 0.1 * total - 1e-9) AS p10,
       min(v) FILTER (WHERE upto >= 0.5 * total - 1e-9) AS p50, min(v) FILTER (WHERE upto >= 0.9 * total - 1e-9) AS p90
FROM c GROUP BY 1, 2, 3""")
def q_leaf_quantiles(spark, sf):
    """The forest's quantile step with three given partitions for trees: a
    training row weighs by its cell's size for every value that it shares."""
    s = split_cohort(spark, sf).withColumn("leaves", F.array(*_LEAVES))
    labels = materialize(leaf_labels(s.where("split = 'train'"), "leaves", "annual_income"))
    asked = s.where("split = 'test'").select(*_LEAVES, "leaves").distinct().withColumn("key", F.to_json("leaves"))
    found = co_member_quantiles(asked, "key", "leaves", labels, leaf_ranges(labels), prefix="p")
    return asked.join(found, "key", "left").select(*_LEAVES, "p10", "p50", "p90")


@query("score_trained")
def q_score_trained(spark, sf):
    """Requests scored by the quantile forest and the fitted classifier."""
    art = artefacts(spark, sf, forest_model(spark, sf).model, premium_model(spark, sf))
    return score(valid_requests(spark, sf), art)


class GroupMedian:
    """A point model: the exact median label of the group."""

    def __init__(self, heads: GroupQuantileModel):
        self.heads = heads

    def transform(self, df: DataFrame) -> DataFrame:
        return self.heads.transform(df).withColumnRenamed("q50", "prediction").drop("q10", "q90")


@query("score_point_model", SCORES.format(more="").replace("annual_income), 0.1)", "annual_income), 0.5)")
       .replace("annual_income), 0.9)", "annual_income), 0.5)"))
def q_score_point(spark, sf):
    """SCO-03: one output, served as three equal quantiles."""
    art = artefacts(spark, sf)
    art.model = PointModel(GroupMedian(art.model))
    return score(valid_requests(spark, sf), art)


def cv_row(spark, sf) -> DataFrame:
    """EVA-12 on the forest's P50 head, in dollars, on the train split only."""
    needed = ["person_id", *fe.FEATURES_FULL, "label", "annual_income"]
    return processed(spark, "cv-row", sf, lambda: tr.cv_scores(engineered(spark, sf)[0].select(*needed), fit_heads, "person_id", FOLDS, prediction="p50"))


def stability_row(spark, sf) -> DataFrame:
    """EVA-13: both heads refitted on every seed's own split."""
    cohort, education, regions = tb.cohort(spark, sf), tb.education(spark), tb.region_map(spark, sf)
    keep = kept_as(cohort)
    cohort, once = (cohort, None) if keep is materialize else (cohort.drop("region", "annual_mean_wage"), written)

    def run(seed: int) -> DataFrame:
        train, test, _ = fe.prepare_split(cohort, education, regions, "person_id", 0.2, seed, keep=once)
        needed = [*fe.FEATURES_FULL, "label", "annual_income", "premium"]
        train, test = (keep(fe.premium_label(fe.log_target(d), T).select(*needed)) for d in (train, test))
        heads = written(fit_heads(train, seed).transform(test).select("annual_income", "p10", "p50", "p90"))
        classes = written(tr.premium_probability(tr.fit_premium(train, seed=seed), test).select("premium", "score"))
        return one_row_of(ev.point_metrics(heads).select(F.col("r2").alias("p50_r2")),
                          ev.interval_metrics(heads).select(F.col("coverage").alias("coverage_80")),
                          ev.roc_auc(classes).select(F.col("roc_auc").alias("clf_roc_auc")),
                          ev.brier(classes).select(F.col("brier").alias("clf_brier")))

    return processed(spark, "stability-row", sf, lambda: tr.seed_stability(run, SEEDS))


@query("cv_scores")
def q_cv(spark, sf):
    return r4(cv_row(spark, sf))


@query("seed_stability")
def q_stability(spark, sf):
    return r4(stability_row(spark, sf))


def _map_of(df: DataFrame, key, value: str, name: str) -> DataFrame:
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, F.round(value, 4)))).alias(name))


def subgroup_auc(classes: DataFrame) -> DataFrame:
    """``attribute, grp, roc_auc`` of groups of 30 rows or more."""
    per = [ev.roc_auc(classes, groups=[c]).select(F.lit(c).alias("attribute"), F.col(c).alias("grp"), "roc_auc",
                                                  (F.col("n_pos") + F.col("n_neg")).alias("n")) for c in ("gender", "region")]
    return per[0].unionByName(per[1]).where("n >= 30 and roc_auc is not null")


@query("metrics_document")
def q_metrics_doc(spark, sf):
    """EVA-18: one row about both heads, with maps for subgroups and parameters."""
    train, test, *_ = engineered(spark, sf)
    sc, classes = forest_scored(spark, sf), premium_scored(spark, sf)
    point = ev.point_metrics(sc).select("r2", "rmse", "mae")
    interval = ev.interval_metrics(sc).select(F.col("coverage").alias("quantile_coverage_80"), F.col("median_width").alias("quantile_width_median"),
                                              F.col("crossings").alias("quantile_crossings"))
    name = F.concat_ws("=", "attribute", "grp")
    subgroups = _map_of(ev.subgroup_coverage(sc), name, "coverage", "subgroup_coverage_80")
    sizes = train.agg(F.count("*").alias("n_train"), F.avg("premium").alias("classifier_positive_rate_train")).join(
        test.agg(F.count("*").alias("n_test"), F.avg("premium").alias("classifier_positive_rate_test")))
    threshold = ev.threshold_metrics(classes).select(*[F.col(c).alias(f"classifier_{c}") for c in ("accuracy", "precision", "recall", "f1")])
    brier = ev.brier(classes).select(F.col("brier").alias("classifier_brier"), F.col("brier_base_rate").alias("classifier_brier_base_rate"))
    auc = ev.roc_auc(classes).select(F.col("roc_auc").alias("classifier_roc_auc"))
    ap = ev.average_precision(classes).select(F.col("average_precision").alias("classifier_pr_auc"))
    majority = ev.positive_rate(test).select(F.col("majority_accuracy").alias("classifier_baseline_majority_acc"))
    logistic = ev.roc_auc(tr.premium_probability(tr.fit_logistic(train), test)).select(
        F.col("roc_auc").alias("classifier_baseline_logreg_roc_auc"))
    by_group = _map_of(subgroup_auc(classes), name, "roc_auc", "classifier_subgroup_roc_auc")
    stability = stability_row(spark, sf).drop("seeds")
    stability = stability.select(*[F.col(c).alias(f"stability_{c}") for c in stability.columns])
    cohort = tb.cohort(spark, sf)
    version = model_version(fingerprint(cohort, ["person_id", "state", "occupation", "annual_income"], money=("annual_income",))).select("model_version")
    forest = QuantileForest(fe.FEATURES_FULL).forest
    params = {k: float(v) for k, v in forest.items()}
    fixed = spark.range(1).select(
        F.lit("dollar").alias("cv_space"), F.lit(True).alias("cv_train_only"), F.array(*[F.lit(a) for a in (0.1, 0.5, 0.9)]).alias("quantile_alphas"),
        F.lit(len(fe.FEATURES_FULL)).alias("n_features"), F.lit(str(date.today())).alias("train_date"),
        F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).alias("hyperparameters"), F.lit(True).alias("log_transform"),
        F.lit("leaf co-membership").alias("objective"), F.lit("binary:logistic").alias("classifier_objective"), F.lit(T).alias("classifier_threshold"),
        F.array(*[F.lit(s) for s in SEEDS]).alias("stability_seeds"))
    doc = one_row_of(version, point, cv_row(spark, sf).drop("folds"), interval, ev.pinball_losses(sc), subgroups, sizes, threshold, brier,
                     auc, ap, majority, logistic, by_group, stability, fixed)
    return r4(materialize(doc))


@query("metric_bands_trained")
def q_bands_trained(spark, sf):
    """EVA-17: the nine rules on the fitted heads."""
    sc, classes = forest_scored(spark, sf), premium_scored(spark, sf)
    return ev.metric_bands(ev.band_values(sc, cv_row(spark, sf), classes, subgroup_auc(classes))).select(
        "metric", "grp", F.round("value", 4).alias("value"), "lo", "hi", "passed")


_ENC = """tm AS (SELECT occupation, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM split WHERE split = 'train' GROUP BY 1),
sm AS (SELECT state, avg(CAST(annual_income AS DECIMAL(38,10))) AS m FROM split WHERE split = 'train' GROUP BY 1),
reg AS (SELECT n.n_name AS state, CAST(dense_rank() OVER (ORDER BY r.r_name) - 1 AS INTEGER) AS region_code
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
f AS (SELECT s.age, s.education_ord, CASE WHEN s.gender = 'Male' THEN 1 ELSE 0 END AS gender_bin,
             coalesce(reg.region_code, 0) AS region_code, s.employment, s.location_quotient, s.jobs_per_1000, s.hourly_mean, s.annual_mean_wage,
             coalesce(tm.m, (SELECT avg(m) FROM tm)) AS occ_mean_income, coalesce(sm.m, (SELECT avg(m) FROM sm)) AS state_mean_income
      FROM split s LEFT JOIN tm USING (occupation) LEFT JOIN sm USING (state) LEFT JOIN reg USING (state) WHERE s.split = 'test')"""


def _sets_sql() -> str:
    one = ("SELECT '{s}' AS feature_set, {i} AS position, '{c}' AS feature, count({c}) AS n, round(min(CAST({c} AS DOUBLE)), 4) AS lo, "
           "round(max(CAST({c} AS DOUBLE)), 4) AS hi, round(avg(CAST({c} AS DECIMAL(38,10))), 3) AS mean FROM f")
    return " UNION ALL ".join(one.format(s=s, i=i, c=c) for s, cols in fe.FEATURE_SETS.items() for i, c in enumerate(cols))


def study_features(spark, sf) -> DataFrame:
    """The engineered test split with all columns of every feature set."""
    return engineered(spark, sf)[1]


@query("feature_sets", S + "," + _ENC + "\n" + _sets_sql())
def q_feature_sets(spark, sf):
    """FEA-09: every feature set in order, with what the test split holds of it, from one pass."""
    test = study_features(spark, sf)
    every = sorted({c for cols in fe.FEATURE_SETS.values() for c in cols})
    from earnlens.functions.metrics import exact_mean
    one = test.agg(*[x for c in every for x in (
        F.count(c).alias(f"{c}_n"), F.min(F.col(c).cast("double")).alias(f"{c}_lo"), F.max(F.col(c).cast("double")).alias(f"{c}_hi"),
        exact_mean(c).alias(f"{c}_mean"))])
    rows = [F.struct(F.lit(s).alias("feature_set"), F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n"),
                     F.round(f"{c}_lo", 4).alias("lo"), F.round(f"{c}_hi", 4).alias("hi"), F.round(f"{c}_mean", 3).alias("mean"))
            for s, cols in fe.FEATURE_SETS.items() for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("gbt_feature_sets")
def q_gbt_sets(spark, sf):
    """MOD-05: the squared-error booster on every feature set."""
    train, test, *_ = engineered(spark, sf)

    def run(name: str) -> DataFrame:
        cols = fe.FEATURE_SETS[name]
        model = tr.fit_gbt_regressor(train, cols)
        return tr.regression_metrics(model, test).select(F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"), "r2", "mae", "rmse")

    rows = tr.side_by_side(run, list(fe.FEATURE_SETS), 4)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return r4(out)


@query("feature_importance")
def q_importance(spark, sf):
    return r4(xp.feature_importance(served_trees(spark, sf), fe.FEATURES_FULL))


@query("permutation_importance")
def q_permutation(spark, sf):
    return r4(xp.permutation_importance(served_trees(spark, sf), engineered(spark, sf)[1], fe.FEATURES_FULL, "person_id", label="label",
                                        repeats=50, prediction="_mean"))


def attributions(spark, sf) -> DataFrame:
    """Of every test row, against every training row."""
    train, test, *_ = engineered(spark, sf)
    return processed(spark, "attributions", sf, lambda: xp.shapley_values(
        served_trees(spark, sf), test, train, fe.FEATURES_FULL, "person_id", prediction="_mean"))


@query("shapley_values")
def q_shapley(spark, sf):
    return r4(xp.mean_abs_attribution(attributions(spark, sf)))


@query("shapley_dependence")
def q_dependence(spark, sf):
    return r4(attributions(spark, sf).where(F.col("feature").isin("age", "occ_mean_income", "state_mean_income")))
