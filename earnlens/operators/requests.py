"""Scoring requests: normalisation and domain validation (PRJ-16, DQ-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.functions.text import normalise_gender, normalise_state
from earnlens.operators.joins import one_row

CONTEXT = ["employment", "location_quotient", "jobs_per_1000", "hourly_mean"]
GENDERS = ("Male", "Female")


def normalise_requests(df: DataFrame) -> DataFrame:
    """State upper-cased, gender trimmed + title case (PRJ-16)."""
    return df.withColumns({"state": normalise_state("state"),
                           "gender": normalise_gender("gender")})


def flag_requests(df: DataFrame, catalogue: DataFrame, age_lo: int = 18,
                  age_hi: int = 80) -> DataFrame:
    """DQ-09: every request with the array ``errors`` of all reasons to reject it: unknown state / occupation / education
    (against the cohort's catalogue of valid values, distinct and
    broadcast after a size check), age outside [age_lo, age_hi], negative
    optional context, gender not Male/Female."""
    flags = []
    out = df
    for col in ("state", "occupation", "education_level"):
        known = catalogue.select(F.col(col).alias(f"_ok_{col}")).distinct().withColumn(
            f"_hit_{col}", F.lit(True))
        out = out.join(known, out[col] == F.col(f"_ok_{col}"), "left").drop(f"_ok_{col}")
        flags.append(F.when(F.col(f"_hit_{col}").isNull(), F.lit(f"unknown {col}")))
    flags.append(F.when(~F.col("age").between(age_lo, age_hi) | F.col("age").isNull(),
                        F.lit("age out of range")))
    for c in CONTEXT:
        if c in df.columns:
            flags.append(F.when(F.col(c) < 0, F.lit(f"negative {c}")))
    flags.append(F.when(~F.col("gender").isin(*GENDERS) | F.col("gender").isNull(),
                        F.lit("invalid gender")))
    out = out.withColumn("errors", F.array_compact(F.array(*flags)))
    return out.drop(*[f"_hit_{c}" for c in ("state", "occupation", "education_level")])


def validate_requests(df: DataFrame, catalogue: DataFrame, age_lo: int = 18,
                      age_hi: int = 80) -> tuple[DataFrame, DataFrame]:
    """DQ-09: split requests into (valid, rejected with ``errors``)."""
    out = flag_requests(df, catalogue, age_lo, age_hi)
    good = out.where(F.size("errors") == 0).drop("errors")
    bad = out.where(F.size("errors") > 0)
    return good, bad


def validation_report(df: DataFrame, catalogue: DataFrame, id_col: str = "request_id") -> DataFrame:
    """One row per request: is_valid, error_count, errors joined by '; '."""
    return flag_requests(df, catalogue).select(
        id_col, (F.size("errors") == 0).alias("is_valid"), F.size("errors").alias("error_count"),
        F.array_join("errors", "; ").alias("errors"))


def batch_verdict(df: DataFrame, catalogue: DataFrame, id_col: str = "request_id",
                  order_col: str = "request_id") -> DataFrame:
    """All-or-nothing batch check: one row (accepted, first_bad_index)
    where the index is the smallest ``order_col`` of a rejected request."""
    _, bad = validate_requests(df, catalogue)
    return bad.agg(F.min(order_col).alias("first_bad")).select(
        F.col("first_bad").isNull().alias("accepted"), "first_bad")
