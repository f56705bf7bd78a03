"""Quantile boosting takes rows equal in all features as units."""

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from earnlens.modeling import booster as bo

PARAMS = dict(rounds=3, step=0.5, max_depth=2, colsample=1.0, checkpoint_every=2)


def _rows(spark, n=3000):
    d = spark.range(n).selectExpr("cast(if(id % 50 = 0, null, id % 6) as double) as a", "cast(id % 4 as double) as b", "id")
    return d.withColumn("label", F.coalesce("a", F.lit(9.0)) * 10 + F.col("b") + F.pmod(F.xxhash64("id"), F.lit(97)) / 9.7)


def _learner_sees(monkeypatch):
    seen, fit = [], DecisionTreeRegressor.fit

    def spy(self, df, *a):
        seen.append((df.count(), df.agg(F.sum("_weight")).first()[0] if "_weight" in df.columns else None))
        return fit(self, df, *a)

    monkeypatch.setattr(DecisionTreeRegressor, "fit", spy)
    return seen


def _same(a, b):
    if not isinstance(a, list):
        assert a == pytest.approx(b, abs=1e-9)
        return
    assert a[:2] == b[:2]
    _same(a[2], b[2])
    _same(a[3], b[3])


def test_units_give_the_trees_of_single_rows(spark, monkeypatch):
    d, seen = _rows(spark).fillna(9.0, ["a"]).repartition(3), _learner_sees(monkeypatch)
    one = bo.QuantileBooster(["a", "b"], subsample=1.0, **PARAMS).fit(d)
    assert {x[0] for x in seen} == {3000}
    del seen[:]
    put = bo.QuantileBooster(["a", "b"], subsample=1.0, single_rows=100, **PARAMS).fit(d)
    assert len(seen) == 9 and all(n < 50 and weight == 3000 for n, weight in seen)
    for x, y in zip(one.heads, put.heads):
        assert x.base == y.base
        for s, t in zip(x.trees, y.trees, strict=True):
            _same(s.root, t.root)


def test_units_are_bounded_and_sampled_by_rows(spark, monkeypatch):
    d = _rows(spark).withColumn("_y", F.col("label"))
    units = bo._units(d.select("a", "b", "_y"), ["a", "b"], most=20)
    assert units.agg(F.max(F.size("_ys"))).first()[0] < 60 and units.count() > 150
    back = units.select("a", "b", F.explode("_ys").alias("_y"))
    assert sorted(map(str, back.collect())) == sorted(map(str, d.select("a", "b", "_y").collect()))
    seen = _learner_sees(monkeypatch)
    bo.QuantileBooster(["a", "b"], subsample=0.7, single_rows=100, **PARAMS).fit(d.fillna(9.0, ["a"]))
    assert all(1900 < weight < 2300 for _, weight in seen)


def test_units_refuse_a_missing_label(spark):
    d = _rows(spark).withColumn("label", F.when(F.col("id") != 1, F.col("label")))
    with pytest.raises(Exception, match="a label is null"):
        bo.QuantileBooster(["a", "b"], single_rows=100, **PARAMS).fit(d.fillna(9.0, ["a"]))
