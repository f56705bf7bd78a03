"""Queries that do their whole job: all rounds, all rows."""

from earnlens.plans import ml_queries as ml
from earnlens.plans import trained_queries as tq
from earnlens.sources import dims


def test_the_booster_runs_the_configured_schedule(spark, monkeypatch):
    seen = []

    class Booster:
        def __init__(self, features, label, **params):
            seen.append(params)

        def fit(self, train):
            return self

    monkeypatch.setattr(ml, "QuantileBooster", Booster)
    monkeypatch.setattr(ml, "engineered", lambda *a: [None])
    monkeypatch.setattr(ml, "_memo", lambda spark, sf, name, build: build())
    ml.booster_model(spark, "")
    assert seen == [dims.BOOSTER_PARAMS] and seen[0]["rounds"] == 169


def test_all_test_rows_are_explained_against_all_training_rows(spark, monkeypatch):
    train, test, seen = spark.range(1500).withColumnRenamed("id", "person_id"), spark.range(900).withColumnRenamed("id", "person_id"), []
    monkeypatch.setattr(tq, "engineered", lambda *a: (train, test))
    monkeypatch.setattr(tq, "served_trees", lambda *a: None)
    monkeypatch.setattr(tq, "processed", lambda spark, name, sf, build: build())
    monkeypatch.setattr(tq.xp, "shapley_values", lambda model, rows, background, *a, **k: seen.extend([rows.count(), background.count()]))
    tq.attributions(spark, "")
    assert seen == [900, 1500]
