"""Bucketed tables, observed rules, required columns, white space, duplicates."""

import pytest
from pyspark.sql import functions as F

from earnlens.functions.text import SPACES, stripped, title_case
from earnlens.operators.clean import require_columns
from earnlens.operators.integrate import build_cohort, duplicate_count
from earnlens.operators.profile import expectation_rules, expectations
from earnlens.sources.io import write_bucketed

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_persons_are_not_shuffled(spark, tmp_path):
    from earnlens.sources import testbed as tb
    persons = tb.persons(spark, SF)
    doubled = persons.unionByName(persons.where("person_id % 3 = 0"))
    table = write_bucketed(doubled, str(tmp_path / "persons"), ["person_id"], 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cohort = build_cohort(table, F.broadcast(tb.wages(spark, SF)))
        plan = plan_of(cohort)
        assert "Bucketed: true" in plan
        assert plan.count("Exchange") == 1 and "BroadcastExchange" in plan  # the wages
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert cohort.count() == build_cohort(persons, tb.wages(spark, SF)).count() > 0


def test_rules_come_from_the_writing_job(spark):
    from earnlens.sources import testbed as tb
    report = tb.cohort_report(spark, SF)
    files = report.inputFiles()
    assert files and all("-observed/" in f for f in files)  # no scan of the cohort
    plain = expectations(tb.cohort(spark, SF), **tb.COHORT_RULES)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(report) == key(plain)
    assert len(expectation_rules(**tb.COHORT_RULES)[1]) == report.count()


def test_missing_columns_raise(spark):
    df = spark.range(1).withColumn("a", F.lit(1))
    require_columns(df, ["id", "a"])
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        require_columns(df, ["a", "b", "c"])


def test_white_space_of_both_ends_goes(spark):
    rows = [f"{c}new york\t\n{c}" for c in SPACES] + ["", " \n", None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(stripped("t")).collect()]
    assert got == [None if r is None else r.strip() for r in rows]
    assert spark.range(1).select(title_case(F.lit("\t new-york o'neil\n"))).first()[0] == "New-York O'Neil"


def test_duplicates_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (2, None)], "x int, y string")
    assert tuple(duplicate_count(df).first()) == (5, 3, 2)
    assert tuple(duplicate_count(df.limit(0)).first()) == (0, 0, 0)
