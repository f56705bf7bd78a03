"""Permuted copies lie where their bucket lies; training tasks hold bounded rows; explanations need the trees only."""

from pyspark.sql import functions as F

from earnlens.modeling import explain as xp
from earnlens.modeling.quantile_forest import QuantileForest
from earnlens.modeling.search import spread, training_frame


def test_copies_are_not_shuffled(spark):
    d = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as id", "cast(id as double) as a", "cast(id * 2 as int) as b")
    c = xp.permuted_copies(d, ["a", "b"], "id", 3, 1, buckets=4)
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    for r in c.groupBy("_feature", "_repeat").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"),
                                                  F.count_if(F.expr("a * 2 != b")).alias("moved")).collect():
        assert (r.n, r.a, r.b) == (300, 44850.0, 89700) and r.moved > 200
    assert sorted(map(str, c.collect())) == sorted(map(str, xp.permuted_copies(d.repartition(7), ["a", "b"], "id", 3, 1, buckets=4).collect()))


def test_training_tasks_hold_bounded_rows(spark):
    one = spark.range(250).coalesce(1)
    assert spread(one, 100).rdd.getNumPartitions() == 3 and spread(one, 250).rdd.getNumPartitions() == 1
    for rows_per_task, n in ((100, 3), (1000, 1)):
        frame = training_frame(spark.range(0, 250, 1, 2), rows_per_task)
        assert frame.rdd.getNumPartitions() == n and frame.count() == 250


def test_trees_are_fitted_without_the_leaf_tables(spark, monkeypatch):
    from earnlens.modeling import quantile_forest as qf
    d = spark.range(400).selectExpr("cast(id % 20 as double) as x", "cast(id % 20 + id % 3 as double) as label")
    forest = QuantileForest(["x"], trees=3, depth=3, columns=1.0)
    with monkeypatch.context() as m:
        m.setattr(qf, "leaf_labels", None)
        trees = forest.fit_trees(d)
    assert xp.feature_importance(trees, ["x"]).first().importance == 1.0
    assert forest.fit(d, trees).trees is trees
