"""Random search with a ledger of trials (MOD-07).

Every (trial, fold) result is written as it ends, under a hash of the trial's
parameters and of what it was fitted to. A search that is started again reads
the ledger, fits what is missing and goes on; a result that is written twice
replaces itself.
"""

from __future__ import annotations

import hashlib
import json
import math
import posixpath
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.operators.evaluate import point_metrics
from earnlens.operators.features import FEATURES_FULL, hash_folds
from earnlens.session import checkpoint_dir, materialize, written
from earnlens.sources.tables import path_exists

SEARCH_SPACE = {"maxDepth": (3, 8), "stepSize": (0.01, 0.3), "maxIter": (100, 500),
                "subsamplingRate": (0.6, 1.0), "columnShare": (0.6, 1.0)}
#: Rows of a training task: boosting makes a job for every tree level, and few
#: rows in many tasks are all overhead.
ROWS_PER_TASK = 100_000
#: Training rows that boosting takes one by one; more are put together where
#: a booster cannot tell them apart.
SINGLE_ROWS = 200_000
WEIGHT = "_weight"


def draw_trials(trials: int, seed: int = 42, space=None) -> list[dict]:
    """``trials`` points of the space; the step is drawn log-uniformly."""
    s, rng = space or SEARCH_SPACE, random.Random(seed)
    return [{"maxDepth": rng.randint(*s["maxDepth"]),
             "stepSize": math.exp(rng.uniform(*map(math.log, s["stepSize"]))),
             "maxIter": rng.randint(*s["maxIter"]),
             "subsamplingRate": rng.uniform(*s["subsamplingRate"]),
             "columnShare": rng.uniform(*s["columnShare"])} for _ in range(trials)]


def training_frame(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` written once, in as many partitions as its rows need."""
    df = materialize(df)
    n = max(1, math.ceil(df.count() / rows_per_task))
    return df.coalesce(n) if n <= df.rdd.getNumPartitions() else df.repartition(n)


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` in more partitions where they would have more rows than a task should hold."""
    n = math.ceil(df.count() / rows_per_task)
    return df if n <= df.rdd.getNumPartitions() else df.repartition(n)


def weighed(df: DataFrame, features, label: str, mean: bool = False, single_rows: int = SINGLE_ROWS) -> DataFrame:
    """``features, label, _weight``: all rows of ``df``, for a booster that
    takes weights. Up to ``single_rows`` rows stay one by one. Of more, rows
    equal in all features and the label become units of up to
    rows / ``single_rows`` rows, weighing as many; subsampling draws units.
    ``mean``: squared error on all rows needs only the mean label of rows
    equal in all features, so these become one, whatever their labels."""
    n = df.count()
    if n <= single_rows:
        return df.select(*features, label, F.lit(1.0).alias(WEIGHT))
    if mean:  # a missing label stays one
        known = F.when(F.count(label) == F.count("*"), F.avg(label))
        return df.groupBy(*features).agg(known.alias(label), F.count("*").cast("double").alias(WEIGHT))
    parts = F.ceil(F.col("_n") / math.ceil(n / single_rows))
    units = df.groupBy(*features, label).agg(F.count("*").alias("_n")).withColumn("_parts", parts)
    units = units.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    weight = F.floor(F.col("_n") / F.col("_parts")) + (F.col("_part") < F.col("_n") % F.col("_parts")).cast("bigint")
    return units.select(*features, label, weight.cast("double").alias(WEIGHT))


def mean_units(df: DataFrame, features, label: str, most: int) -> DataFrame:
    """``features, label, _weight``: rows equal in all features put together at
    random into units of about ``most`` rows at most, with their mean label and
    their number. Squared error tells such rows apart by that mean only, and a
    bag of units spreads like a bag of rows (the mean of a unit has the variance
    of its rows' mean)."""
    rows = df.select(*features, label, F.xxhash64(*features).alias("_key"))
    often = rows.groupBy("_key").agg(F.ceil(F.count("*") / most).alias("_parts")).where("_parts > 1")
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).join(often, "_key", "left")
    part = F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_parts")), F.lit(0))
    return rows.groupBy(*features, part.alias("_part")).agg(F.avg(label).alias(label), F.count("*").cast("double").alias(WEIGHT)).drop("_part")


def in_tasks(df: DataFrame, features, rows_per_task: int) -> DataFrame:
    """``df`` written once and dealt into tasks of about so many rows, in an order of its own values."""
    df = written(df)
    n = max(1, math.ceil(df.count() / rows_per_task))
    return written(df.repartition(n, *features).sortWithinPartitions(*df.columns))


def same_features(left: DataFrame, cells: DataFrame, features, how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``cells``, which has one row for all
    rows that are equal in all features (missing ones too)."""
    named = cells.withColumnsRenamed({f: f"_cell_{f}" for f in features})
    met = [F.col(f).eqNullSafe(F.col(f"_cell_{f}")) for f in features]
    return left.join(named, met, how).drop(*[f"_cell_{f}" for f in features])


class TrialLedger:
    """Results in a folder: one row for each trial and fold, ``trial_key,
    fold, params, r2, seconds``."""

    SCHEMA = "trial_key string, fold int, params string, r2 double, seconds double"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or posixpath.join(checkpoint_dir(spark), "trials", uuid.uuid4().hex)

    @staticmethod
    def key(params: dict, about: dict) -> str:
        """Equal for equal parameters on equal input."""
        return hashlib.sha256(json.dumps([params, about], sort_keys=True).encode()).hexdigest()[:24]

    def rows(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).parquet(self.path)

    def known(self) -> dict[tuple[str, int], float]:
        """Results so far: trials x folds of them, a bounded table."""
        return {(r.trial_key, r.fold): r.r2 for r in self.rows().collect()}

    def write(self, key: str, fold: int, params: dict, r2: float, seconds: float) -> None:
        row = self.spark.createDataFrame([(key, fold, json.dumps(params, sort_keys=True), float(r2), float(seconds))], self.SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(posixpath.join(self.path, key, str(fold)))


@dataclass
class SearchResult:
    """``avgMetrics``: mean R2 of every trial; ``bestModel``: the best trial
    refitted on all of the training rows; ``fitted``: fits of this run."""

    bestModel: object
    avgMetrics: list[float]
    fitted: int


def booster(trial: dict, features, label: str, seed: int) -> Pipeline:
    from earnlens.modeling.train import assembler
    params = {k: v for k, v in trial.items() if k != "columnShare"}
    return Pipeline(stages=[assembler(features), GBTRegressor(
        featuresCol="features", labelCol=label, seed=seed, featureSubsetStrategy=f"{trial['columnShare']:.6f}", **params)])


def random_search(train: DataFrame, key: str, trials: int = 30, k: int = 5, seed: int = 42,
                  features=FEATURES_FULL, label: str = "annual_income", parallelism: int = 4,
                  space=None, ledger: TrialLedger | None = None):
    """MOD-07: random search over ``SEARCH_SPACE`` maximising CV R2 (hash
    folds); fits run side by side and are kept in ``ledger``. Columns are
    sampled for each node, Spark's way. Returns the result and the trials'
    table."""
    spark = train.sparkSession
    ledger = ledger or TrialLedger(spark)
    rows = training_frame(hash_folds(train, key, k, seed))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*features, label).cast("decimal(38,0)")).cast("string").alias("sum")).first()
    about = {"rows": size["n"], "content": size["sum"], "features": list(features), "label": label, "folds": k, "seed": seed}
    drawn = draw_trials(trials, seed, space)
    keys = [ledger.key(t, about) for t in drawn]
    known = ledger.known()

    def run(job: tuple[int, int]) -> None:
        i, fold = job
        start = time.time()
        model = booster(drawn[i], features, label, seed).fit(rows.where(F.col("fold") != fold))
        r2 = point_metrics(model.transform(rows.where(F.col("fold") == fold)), label, "prediction").first()["r2"]
        ledger.write(keys[i], fold, drawn[i], r2, time.time() - start)

    missing = [(i, f) for i in range(trials) for f in range(k) if (keys[i], f) not in known]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for done in [pool.submit(run, job) for job in missing]:
            done.result()
    known = ledger.known()
    means = [sum(known[key_, f] for f in range(k)) / k for key_ in keys]
    best = booster(drawn[max(range(trials), key=means.__getitem__)], features, label, seed).fit(rows)
    table = [(i, float(t["maxDepth"]), t["stepSize"], float(t["maxIter"]), t["subsamplingRate"], t["columnShare"], m)
             for i, (t, m) in enumerate(zip(drawn, means))]
    return SearchResult(best, means, len(missing)), spark.createDataFrame(
        table, "trial int, max_depth double, step double, max_iter double, subsample double, column_share double, cv_r2 double")
