"""The integrate job: persons x wages -> cohort (JOIN-01, DED-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.sources import dims


def build_cohort(persons: DataFrame, wages: DataFrame, keys=("occupation", "state"),
                 floor: float | None = dims.MIN_ANNUAL_INCOME,
                 income: str = "annual_income") -> DataFrame:
    """Inner many-to-one join of persons to their (occupation, state) wage
    row, after the income floor, then exact-duplicate removal.

    The wage table has one row per (occupation, state); AQE broadcasts it at
    runtime when it measures small. Persons from a table bucketed by their id
    (:func:`earnlens.sources.io.write_bucketed`) are then shuffled neither for
    the join nor for DED-01: equal rows have equal ids, so they share a bucket."""
    if floor is not None:
        persons = persons.where(F.col(income) >= floor)
    j = persons.join(wages, list(keys), "inner")
    return drop_exact_duplicates(j)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """DED-01: keep one of each set of identical rows (hash-partitioned
    distinct with map-side pre-aggregation)."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """PRF-05: rows minus distinct rows, as one row (bigint), in one pass."""
    each = df.groupBy(*df.columns).agg(F.count("*").alias("_times"))
    rows = F.coalesce(F.sum("_times"), F.lit(0))
    return each.agg(rows.alias("rows"), F.count("*").alias("distinct_rows"), (rows - F.count("*")).alias("duplicate_rows"))
