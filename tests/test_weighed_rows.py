"""Boosting takes rows it cannot tell apart as one that weighs as many."""

from pyspark.sql import functions as F

from earnlens.modeling import search
from earnlens.modeling import train as tr


def _rows(spark, n=3000):
    d = spark.range(n).selectExpr("cast(if(id % 50 = 0, null, id % 6) as double) as a", "cast(id % 4 as double) as b", "id")
    return d.withColumn("income", F.coalesce("a", F.lit(9.0)) * 10 + F.col("b") + F.col("id") % 3).withColumn(
        "premium", (F.col("income") + F.col("id") % 5 > 32).cast("double"))


def test_units_weigh_all_rows(spark):
    d = _rows(spark)
    few = search.weighed(d, ["a", "b"], "premium", single_rows=3000)
    assert few.count() == 3000 and few.agg(F.max("_weight")).first()[0] == 1.0
    units = search.weighed(d, ["a", "b"], "premium", single_rows=300)
    assert units.agg(F.max("_weight")).first()[0] <= 10 and units.count() < 400
    summed = units.groupBy("a", "b", "premium").agg(F.sum("_weight").cast("long").alias("n"))
    assert sorted(map(str, summed.collect())) == sorted(map(str, d.groupBy("a", "b", "premium").agg(F.count("*").alias("n")).collect()))
    one = search.weighed(d, ["a", "b"], "income", mean=True, single_rows=300)
    assert one.count() == d.select("a", "b").distinct().count() and one.agg(F.sum("_weight")).first()[0] == 3000
    gap = d.withColumn("income", F.when(F.col("id") != 1, F.col("income")))
    assert search.weighed(gap, ["a", "b"], "income", mean=True, single_rows=300).where("income is null").count() == 1


def test_boosters_fit_the_same_trees(spark, monkeypatch):
    d = _rows(spark).fillna(9.0, ["a"]).repartition(3)
    fits = (lambda: tr.fit_gbt_regressor(d, ["a", "b"], "income", maxIter=5),
            lambda: tr.fit_premium(d, ["a", "b"], maxIter=5, subsamplingRate=1.0, featureSubsetStrategy="all"))
    whole = [fit().transform(d.select("id", "a", "b")).select("id", "prediction").collect() for fit in fits]
    seen = []
    monkeypatch.setattr(tr, "weighed", lambda *a, **k: seen.append(search.weighed(*a, **k, single_rows=100)) or seen[-1])
    put = [fit().transform(d.select("id", "a", "b")).select("id", "prediction").collect() for fit in fits]
    assert [s.count() < 200 for s in seen] == [True, True]
    for a, b in zip(whole, put):
        a, b = dict(a), dict(b)
        assert max(abs(a[k] - b[k]) for k in a) < 1e-6
