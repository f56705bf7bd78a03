"""Registered queries: name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL)."""

from earnlens.plans.registry import ORACLE, QUERIES  # noqa: F401
