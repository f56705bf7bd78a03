"""MOD-07: a search that was cut off goes on where it stopped."""

import pytest
from pyspark.sql import functions as F

from earnlens.modeling import search


def test_search_resumes_from_its_ledger(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("x"),
                                 (F.col("id") % 5).cast("double").alias("z"))
    df = df.withColumn("y", 3 * F.col("x") + F.col("z"))
    space = dict(search.SEARCH_SPACE, maxIter=(2, 3), maxDepth=(2, 3))
    ledger = search.TrialLedger(spark)
    args = dict(features=["x", "z"], label="y", space=space, ledger=ledger)
    real, left = ledger.write, [3]

    def failing(*a):
        if not left[0]:
            raise RuntimeError("cut off")
        left[0] -= 1
        real(*a)

    monkeypatch.setattr(ledger, "write", failing)
    with pytest.raises(RuntimeError):
        search.random_search(df, "k", 3, 2, parallelism=1, **args)
    assert len(ledger.known()) == 3
    monkeypatch.undo()
    result, trials = search.random_search(df, "k", 3, 2, **args)
    assert result.fitted == 3 and len(ledger.known()) == 6 and trials.count() == 3
    again, _ = search.random_search(df, "k", 3, 2, **args)
    assert again.fitted == 0 and again.avgMetrics == result.avgMetrics
    other, _ = search.random_search(df.where("k < 150"), "k", 3, 2, **args)
    assert other.fitted == 6  # other rows, other results
    row = ledger.rows().first()
    assert row.seconds > 0 and "maxDepth" in row.params
