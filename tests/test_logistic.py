"""The logistic baseline in a session that has observed a query."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from earnlens.modeling import train as tr
from earnlens.operators import evaluate as ev


def test_logistic_scores_after_an_observed_query(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"))
    df = df.withColumn("premium", (F.col("x1") + F.col("x2") > 12).cast("double"))
    seen = Observation("rows")
    df.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 400
    scored = tr.premium_probability(tr.fit_logistic(df, ["x1", "x2"]), df)
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    row = ev.roc_auc(scored).first()
    assert row.n_pos + row.n_neg == 400 and row.roc_auc > 0.95
