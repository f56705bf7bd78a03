"""Classifier, baselines, cross-validation, seed stability and the runs table
(MOD-02..06, MOD-08/09, EVA-12/13). All fits are Spark ML jobs; the search is in ``search``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.modeling.search import (SEARCH_SPACE, SINGLE_ROWS, WEIGHT, draw_trials, random_search, same_features, spread,  # noqa: F401
                                      training_frame, weighed)
from earnlens.operators import evaluate as ev
from earnlens.operators.features import FEATURES_FULL, hash_folds
from earnlens.session import written
from earnlens.sources import dims

CLASSIFIER = dims.CLASSIFIER_PARAMS


def assembler(features=FEATURES_FULL, out: str = "features") -> VectorAssembler:
    """FEA-08: the ordered feature vector."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def fit_premium(train: DataFrame, features=FEATURES_FULL, label: str = "premium",
                seed: int = 42, **params):
    """MOD-02: boosted-tree premium classifier (no class weights)."""
    p = dict(CLASSIFIER, **params)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol=WEIGHT, seed=seed, **p)
    return Pipeline(stages=[assembler(features), gbt]).fit(training_frame(weighed(train, features, label)))


def premium_probability(model, df: DataFrame, out: str = "score") -> DataFrame:
    """SCO-05: P(premium) = probability[1]; rows equal in all features are scored once."""
    features = model.stages[0].getInputCols()
    cells = model.transform(df.select(*features).distinct()).select(*features, vector_to_array("probability")[1].alias(out))
    return same_features(df.drop(out), cells, features)


def fit_logistic(train: DataFrame, features=FEATURES_FULL, label: str = "premium", single_rows: int = SINGLE_ROWS):
    """MOD-03: standardised logistic regression, L2 with sklearn's C = 1
    (Spark's regParam = 1 / n). The model goes without its training summary:
    that holds the session, and a session that has observed a query
    (``DataFrame.observe``) cannot be sent to tasks. Above ``single_rows`` rows
    those equal in all features and the label enter the loss as one that weighs
    as many; the scaler still sees every row."""
    n = train.count()
    asm, scaler = assembler(features), StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="z", labelCol=label, regParam=1.0 / n,
                            elasticNetParam=0.0, maxIter=1000)
    if n <= single_rows:
        model = Pipeline(stages=[asm, scaler, lr]).fit(train)
    else:
        scaled = scaler.fit(asm.transform(train.select(*features)))
        units = training_frame(train.groupBy(*features, label).agg(F.count("*").cast("double").alias(WEIGHT)))
        model = PipelineModel([asm, scaled, lr.setWeightCol(WEIGHT).fit(scaled.transform(asm.transform(units)))])
    model.stages[-1]._call_java("setSummary", train.sparkSession._jvm.scala.Option.empty())
    return model


def fit_ridge(train: DataFrame, features=FEATURES_FULL, label: str = "annual_income",
              alpha: float = 1.0):
    """MOD-04: ridge with sklearn alpha (Spark minimises 1/(2n) SSE +
    regParam/2 ||w||^2, so regParam = alpha / n), unstandardised."""
    n = train.count()
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha / n,
                          elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[assembler(features), lr]).fit(train)


def fit_gbt_regressor(train: DataFrame, features=FEATURES_FULL, label: str = "annual_income",
                      seed: int = 42, **params):
    """MOD-05: squared-error booster."""
    p = dict(dict(maxIter=100, maxDepth=4, stepSize=0.1), **params)
    rows = weighed(train, features, label, mean=p.get("subsamplingRate", 1.0) == 1.0)
    return Pipeline(stages=[assembler(features), GBTRegressor(featuresCol="features", labelCol=label, weightCol=WEIGHT,
                                                              seed=seed, **p)]).fit(training_frame(rows))


def fit_forest(train: DataFrame, features=FEATURES_FULL, label: str = "annual_income",
               seed: int = 42, **params):
    """MOD-06: the alternative-booster comparison slot (random forest)."""
    p = dict(dict(numTrees=100, maxDepth=6), **params)
    return Pipeline(stages=[assembler(features), RandomForestRegressor(
        featuresCol="features", labelCol=label, seed=seed, **p)]).fit(spread(train))


def regression_metrics(model, df: DataFrame, label: str = "annual_income") -> DataFrame:
    return ev.point_metrics(model.transform(df), label, "prediction")


def compare_models(train: DataFrame, test: DataFrame, features=FEATURES_FULL,
                   label: str = "annual_income") -> DataFrame:
    """MOD-09/TOP-06: fit the regression baselines and rank them by R2."""
    fits = {"ridge": fit_ridge, "gbt": fit_gbt_regressor, "forest": fit_forest}
    rows = None
    for name, fn in fits.items():
        m = regression_metrics(fn(train, features, label), test, label).withColumn(
            "model", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return rows.orderBy(F.col("r2").desc())


def side_by_side(run, over, parallelism: int) -> list:
    """``run`` of every item, some at a time: independent Spark jobs."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(run, over))


def cv_scores(train: DataFrame, fit, key: str, k: int = 5, seed: int = 42, label: str = "annual_income",
              prediction: str = "prediction", parallelism: int = 5, single_rows: int = SINGLE_ROWS) -> DataFrame:
    """EVA-12: k-fold CV on the train split (hash folds), R2 per fold, then
    mean and population std. Each fold is a distributed fit; ``fit(rows)``
    gives a model whose ``transform`` adds ``prediction``. Above ``single_rows``
    rows the folds are read from one Parquet table."""
    rows = hash_folds(train, key, k, seed)
    rows = training_frame(rows) if train.count() <= single_rows else written(rows)

    def run(i: int) -> tuple:
        scored = fit(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i))
        return i, ev.point_metrics(scored, label, prediction).first()["r2"]

    per = train.sparkSession.createDataFrame(side_by_side(run, range(k), parallelism), "fold int, r2 double")
    return per.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                   F.count("*").alias("folds"))


def seed_stability(run, seeds=(11, 22, 33, 44, 55), parallelism: int = 5) -> DataFrame:
    """EVA-13: ``run(seed) -> one-row DataFrame of metrics`` (a new split and
    new fits); mean and population std of every metric over the seeds."""
    runs = side_by_side(lambda s: run(s), seeds, parallelism)
    kept = side_by_side(lambda r: r.first().asDict(), runs, parallelism)
    metrics = list(kept[0])
    rows = runs[0].sparkSession.createDataFrame([tuple(r[m] for m in metrics) for r in kept], ", ".join(f"{m} double" for m in metrics))
    return rows.agg(F.count("*").alias("seeds"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"),
                                                                                F.stddev_pop(m).alias(f"{m}_std"))])


def search_gain(best, train: DataFrame, test: DataFrame, features=FEATURES_FULL,
                label: str = "annual_income") -> DataFrame:
    """MOD-07: the refitted best trial on the test split, and its R2 less that
    of the booster with its default parameters (MOD-05), as one row."""
    own = regression_metrics(best, test, label).select(*[F.col(c).alias(f"test_{c}") for c in ("r2", "rmse", "mae")])
    default = regression_metrics(fit_gbt_regressor(train, features, label), test, label).select(F.col("r2").alias("default_r2"))
    return own.crossJoin(default).withColumn("delta_r2", F.col("test_r2") - F.col("default_r2"))


def run_row(spark, name: str, params: dict, metrics: dict, feature_set: str, n_train: int,
            n_test: int) -> DataFrame:
    """MOD-09/EVA-18: one row of the runs table (append with unionByName or
    ``write.mode('append')``)."""
    return spark.createDataFrame([(name, str(date.today()), feature_set, n_train, n_test,
                                   {k: float(v) for k, v in params.items()},
                                   {k: float(v) for k, v in metrics.items()})],
                                 "model string, run_date string, feature_set string, n_train long, "
                                 "n_test long, params map<string,double>, metrics map<string,double>")
