"""Runs of line hashes are tables that a merge join reads as they are."""

from pyspark.sql import functions as F

from earnlens.llm import line_dedup


def test_merge_join_of_runs_needs_no_exchange_and_no_sort(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a common line that every one of the documents holds\n"), F.repeat(F.lit("line of its own "), 3), F.col("id").cast("string")).alias("text"))
    lines = line_dedup.line_hashes(docs)
    runs = line_dedup.LineRuns(fanout=8)
    for low, high in ((2000, 4000), (500, 2000), (0, 500)):
        runs.add(lines.where(f"_d >= {low} and _d < {high}"))
    a, b, c = runs.levels[0]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", line_dedup.SORTED_SCAN: "true"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = line_dedup.merge([a, b])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("SortMergeJoin") == 1 and "Exchange" not in plan and "Sort [" not in plan
    assert plan.count("Bucketed: true") == 2
    counts = sorted(runs.merged().groupBy("n_docs").count().collect())
    assert [tuple(r) for r in counts] == [(1, 4000), (4000, 1)]
    assert runs.merged().where("n_docs = 4000").first().top == 3999
    compact = line_dedup.LineRuns(fanout=2)
    for low, high in ((2000, 4000), (500, 2000), (0, 500)):
        compact.add(lines.where(f"_d >= {low} and _d < {high}"))
    assert [len(x) for x in compact.levels] == [1, 1]
    assert compact.merged().exceptAll(runs.merged()).count() == 0
