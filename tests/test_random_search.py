"""MOD-07: the reference's space, and the refit of the best trial."""

import math

from pyspark.sql import functions as F

from earnlens.modeling import train as tr


def test_space_is_the_references():
    drawn = tr.draw_trials(2000)
    for name, (low, high) in {"maxDepth": (3, 8), "stepSize": (0.01, 0.3), "maxIter": (100, 500),
                              "subsamplingRate": (0.6, 1.0), "columnShare": (0.6, 1.0)}.items():
        values = [t[name] for t in drawn]
        assert low <= min(values) and max(values) <= high and max(values) - min(values) > 0.9 * (high - low)
    steps = sorted(t["stepSize"] for t in drawn)
    assert abs(math.log(steps[1000]) - math.log(0.01 * 0.3) / 2) < 0.2  # uniform draws have their median at 0.155
    assert tr.random_search.__defaults__[:2] == (30, 5)


def test_best_trial_is_refitted_and_compared(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"),
                                 (F.col("id") % 5).cast("double").alias("z"))
    df = df.withColumn("y", 3 * F.col("x") + F.col("z"))
    space = dict(tr.SEARCH_SPACE, maxIter=(2, 4), maxDepth=(2, 3))
    model, trials = tr.random_search(df.where("k < 240"), "k", 2, 2, features=["x", "z"], label="y", space=space)
    shares = {r.column_share for r in trials.collect()}
    best = model.bestModel.stages[-1]
    assert len(shares) == 2 and any(abs(float(best.getFeatureSubsetStrategy()) - s) < 1e-5 for s in shares)
    gain = tr.search_gain(model.bestModel, df.where("k < 240"), df.where("k >= 240"), ["x", "z"], "y").collect()
    assert len(gain) == 1 and abs(gain[0].delta_r2 - (gain[0].test_r2 - gain[0].default_r2)) < 1e-12
