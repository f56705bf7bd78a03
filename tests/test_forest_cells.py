"""Large training sets: rows equal in all features go through the trees once, as units and cells."""

import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.modeling import quantile_forest as qf
from earnlens.modeling import search
from earnlens.modeling import train as tr
from earnlens.operators import features as fe


def _rows(spark, n=4000):
    d = spark.range(n).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 3 as int) as b", "cast(id % 7 > 3 as int) as c")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 250.0
    return d.withColumn("label", F.col("a") + F.col("b") + noise).withColumn("premium", (F.col("label") + noise > 9).cast("double")).cache()


def test_mean_units_hold_all_rows(spark):
    d = _rows(spark).withColumn("a", F.when(F.col("a") != 2, F.col("a")))
    units = search.mean_units(d, ["a", "b"], "label", 20).cache()
    assert 150 < units.count() < 300 and units.agg(F.max("_weight")).first()[0] < 45
    whole = {(r.a, r.b): (r.n, r.s) for r in d.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()}
    put = {(r.a, r.b): (r.n, r.s) for r in units.groupBy("a", "b").agg(F.sum("_weight").alias("n"), F.sum(F.expr("_weight * label")).alias("s")).collect()}
    assert set(put) == set(whole) and all(put[k] == pytest.approx(whole[k]) for k in whole)


def test_forest_of_units_and_cells(spark, monkeypatch, tmp_path):
    d, seen, fit = _rows(spark), [], RandomForestRegressor.fit

    def spy(self, df, *a):
        seen.append((df.count(), self.getMinInstancesPerNode(), self.getMinWeightFractionPerNode()))
        return fit(self, df, *a)

    monkeypatch.setattr(RandomForestRegressor, "fit", spy)
    monkeypatch.setattr(DataFrame, "toPandas", None)  # the leaf table reaches the driver as numbers, not as objects
    monkeypatch.setattr(DataFrame, "collect", None)
    forest = qf.QuantileForest(["a", "b"], trees=6, depth=3, columns=1.0, single_rows=200)
    trees = forest.fit_trees(d)
    ((units, least, share),) = seen
    assert units < 500 and least == 1 and share == pytest.approx(20 / 4000)
    put = forest.fit(d, trees)
    single = qf.QuantileForest(["a", "b"], trees=6, depth=3, columns=1.0).fit(d, trees)
    assert put.cells is not None and single.cells is None and put.labels.count() == 4000
    monkeypatch.undo()
    few = qf.QuantileForest(["a", "b"], trees=6, depth=3, columns=1.0, single_rows=200)
    monkeypatch.setattr(qf, "MOST_CELLS", 5)
    wide = few.fit(d, trees)
    assert wide.cells is None
    asked = d.limit(300).withColumn("a", F.when(F.col("id") != 1, F.col("a")))
    heads = [sorted(map(tuple, m.transform(asked).select("id", "q10", "q50", "q90").collect())) for m in (put, single, wide)]
    assert heads[0] == heads[1] == heads[2] and len(heads[0]) == 300
    put.save(str(tmp_path / "f"))
    back = qf.QuantileForestModel.load(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, back.transform(asked).select("id", "q10", "q50", "q90").collect())) == heads[0]


def test_logistic_of_units(spark):
    d = _rows(spark)
    one, put = tr.fit_logistic(d, ["a", "b"]), tr.fit_logistic(d, ["a", "b"], single_rows=100)
    assert put.stages[-1].getWeightCol() == "_weight"
    assert list(put.stages[-1].coefficients) == pytest.approx(list(one.stages[-1].coefficients), abs=1e-4)
    assert list(put.stages[1].mean) == pytest.approx(list(one.stages[1].mean))


def test_probability_of_equal_rows_is_found_once(spark):
    d, asked = _rows(spark), []
    model = tr.fit_premium(d, ["a", "b"], maxIter=3)

    class Spy:
        stages = model.stages

        def transform(self, df):
            asked.append(df.count())
            return model.transform(df)

    got = tr.premium_probability(Spy(), d)
    assert asked == [21] and got.columns == [*d.columns, "score"] and got.count() == 4000
    own = {r.id: r.probability[1] for r in model.transform(d).collect()}
    assert all(own[r.id] == r.score for r in got.collect())


def test_split_and_means_are_kept_once(spark):
    d = _rows(spark).selectExpr("id", "cast(a as string) as occupation", "cast(b as string) as state", "'x' as education_level",
                                "'Male' as gender", "label as annual_income")
    education, regions = spark.createDataFrame([("x", 1)], "education_level string, education_ord int"), spark.createDataFrame(
        [("0", "r", 1)], "state string, region string, region_code int")
    kept = []
    plain = fe.prepare_split(d, education, regions, "id")[0]
    once = fe.prepare_split(d, education, regions, "id", keep=lambda x: kept.append(x) or x)[0]
    assert len(kept) == 3 and sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
