"""Cleaning of the two raw sources (PRJ-01..11, FLT-01..05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.functions.text import first_digits, recode, strip_hyphens, title_case, to_number
from earnlens.operators.joins import lookup
from earnlens.sources import dims

WAGE_COLUMNS = ["AREA_TITLE", "PRIM_STATE", "LOC_QUOTIENT", "OCC_CODE", "OCC_TITLE",
                "TOT_EMP", "JOBS_1000", "H_MEAN", "A_MEAN"]
WAGE_NUMERIC = ["LOC_QUOTIENT", "TOT_EMP", "JOBS_1000", "H_MEAN", "A_MEAN"]
PERSON_COLUMNS = ["STATEICP", "DEGFIELDD", "EDUCD", "OCCSOC", "INCTOT", "SEX", "AGE"]
SEX_LABELS = {1: "Male", 2: "Female"}


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ-01 column subset (missing names raise, as a selection would)."""
    require_columns(df, cols)
    return df.select(*cols)


def reorder(df: DataFrame, preferred: list[str]) -> DataFrame:
    """PRJ-02: keep preferred columns that exist, in that order; none -> error."""
    keep = [c for c in preferred if c in df.columns]
    if not keep:
        raise ValueError("none of the preferred columns are present")
    return df.select(*keep)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ-03: rename only the columns that exist."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def pick_column(df: DataFrame, *candidates: str) -> str:
    """PRJ-14: first candidate present in ``df``."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} present")


def require_columns(df: DataFrame, cols) -> None:
    """DQ-01: raise listing the missing names."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def clean_wages(raw: DataFrame, excluded=dims.EXCLUDED_AREAS,
                min_annual: float = dims.MIN_ANNUAL_INCOME,
                min_hourly: float = dims.MIN_HOURLY_MEAN) -> DataFrame:
    """Raw wage text -> cleaned high-pay wage rows.

    Order is the reference's: coerce, normalise, drop nulls in any column,
    drop territories, then the high-pay rule (so a row missing its hourly
    wage is lost even when the annual wage qualifies)."""
    df = project(raw, WAGE_COLUMNS)
    df = df.withColumns({c: to_number(c) for c in WAGE_NUMERIC})
    df = df.withColumns({
        "AREA_TITLE": title_case("AREA_TITLE"),
        "OCC_TITLE": title_case("OCC_TITLE"),
        "OCC_CODE": strip_hyphens("OCC_CODE"),
    })
    df = df.where(F.col("OCC_CODE").isNotNull() & (F.col("OCC_CODE") != ""))
    df = df.dropna("any")
    df = df.where(~F.col("PRIM_STATE").isin(*excluded))
    df = df.where((F.col("A_MEAN") >= min_annual) | (F.col("H_MEAN") >= min_hourly))
    return df.withColumnRenamed("AREA_TITLE", "STATE")


def clean_persons(raw: DataFrame, state_dim: DataFrame, education_dim: DataFrame,
                  degree_dim: DataFrame, floor: float = dims.MIN_ANNUAL_INCOME,
                  missing_sex: str | None = "nan") -> DataFrame:
    """Raw person rows -> decoded, null-free person rows.

    ``state_dim``: (STATEICP int, STATE string); ``education_dim``:
    (EDUCD int, EDUCATION string); ``degree_dim``: (DEGFIELDD int,
    DEGREE string). Unknown codes give null and the row is dropped; a
    missing SEX is kept as the text ``missing_sex`` (None: the row is dropped); the
    degree name only serves that null test and is not carried on."""
    df = raw.where(F.col("INCTOT") >= floor).select(*PERSON_COLUMNS)
    df = df.withColumns({
        "OCC_CODE": first_digits("OCCSOC", 6),
        "SEX": F.coalesce(recode("SEX", SEX_LABELS, keep=True), F.lit(missing_sex)),
    }).drop("OCCSOC")
    df = lookup(df, state_dim, "STATEICP")
    df = lookup(df, education_dim, "EDUCD")
    df = lookup(df, degree_dim, "DEGFIELDD")
    df = df.dropna("any").drop("DEGREE")
    return df
