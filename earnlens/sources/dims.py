"""Dimension tables (SRC-04) and their checks (DQ-08).

The labour-market dimensions are fixed configuration values; the test-table
dimensions are derived from the supplied ``nation``/``region`` tables or
from the fixed priority labels of ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's configuration)
# ---------------------------------------------------------------------------
MIN_ANNUAL_INCOME = 100000
MIN_HOURLY_MEAN = 48.08
HOURS_PER_YEAR = 2080
PREMIUM_THRESHOLD = 150000
EXCLUDED_AREAS = ("GU", "PR", "VI", "DC")
EDUCATION_ORDER = {
    "Bachelor's degree": 1,
    "Master's degree": 2,
    "Professional degree": 3,
    "Doctoral degree": 4,
}
REGIONS = {
    "Northeast": ["CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"],
    "Midwest": ["IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"],
    "South": ["DE", "FL", "GA", "MD", "NC", "SC", "VA", "WV", "AL", "KY", "MS", "TN",
              "AR", "LA", "OK", "TX"],
    "West": ["AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"],
}
SERVING_REGION_FALLBACK = "South"
DRIFT_WINDOW = 500
DRIFT_THRESHOLD = 2.0
DRIFT_MIN_OBS = 30
SUBGROUP_MIN_N = 30
QUANTILES = (0.1, 0.5, 0.9)
BOOSTER_PARAMS = dict(rounds=169, max_depth=3, step=0.045, subsample=0.741,
                      colsample=0.829, reg_lambda=9.88)
CLASSIFIER_PARAMS = dict(maxIter=200, maxDepth=4, stepSize=0.05, subsamplingRate=0.85,
                         featureSubsetStrategy="0.85")

# Test-table stand-ins: order priorities play education levels (fixed
# labels of the orders table), ordinal = leading digit.
TESTBED_EDUCATION_ORDER = {
    "1-URGENT": 1,
    "2-HIGH": 2,
    "3-MEDIUM": 3,
    "4-NOT SPECIFIED": 4,
    "5-LOW": 5,
}
TESTBED_PREMIUM_THRESHOLD = 300000


def education_dim(spark: SparkSession, order: dict | None = None) -> DataFrame:
    """(education_level string, education_ord int)."""
    order = order or EDUCATION_ORDER
    return spark.createDataFrame(sorted(order.items(), key=lambda kv: kv[1]),
                                 "education_level string, education_ord int")


def region_dim(spark: SparkSession, regions: dict | None = None) -> DataFrame:
    """state -> region, the inversion of region -> [states]
    (``explode``), plus an alphabetical region code 0..k-1."""
    regions = regions or REGIONS
    df = spark.createDataFrame(sorted(regions.items()), "region string, states array<string>")
    inv = df.select(F.explode("states").alias("state"), "region")
    codes = region_codes(spark, sorted(regions))
    return inv.join(codes, "region")


def region_codes(spark: SparkSession, regions: list[str]) -> DataFrame:
    """Alphabetical region code (FEA-04)."""
    return spark.createDataFrame([(r, i) for i, r in enumerate(sorted(regions))],
                                 "region string, region_code int")


def testbed_region_dim(nation: DataFrame, region: DataFrame) -> DataFrame:
    """state (= nation name) -> region name + alphabetical code, from data."""
    codes = region.select(
        "r_name",
        (F.dense_rank().over(_w_all("r_name")) - 1).cast("int").alias("region_code"))
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .join(codes, "r_name")
            .select(F.col("n_name").alias("state"), F.col("r_name").alias("region"),
                    "region_code"))


def _w_all(order_col: str):
    # Region is a fixed 5-row table: a global ordering window is harmless here.
    from pyspark.sql import Window
    return Window.orderBy(order_col)


def check_dimensions(region_map: DataFrame, education: DataFrame,
                     expected_states: int = 50) -> DataFrame:
    """DQ-08: regions cover exactly ``expected_states`` distinct states with no
    duplicates; ordinals are exactly 1..N. Returns (rule, passed, observed)."""
    r = region_map.agg(F.count("*").alias("n"), F.countDistinct("state").alias("d"))
    e = education.agg(F.count("*").alias("n"), F.countDistinct("education_ord").alias("d"),
                      F.min("education_ord").alias("lo"), F.max("education_ord").alias("hi"))
    rows = r.crossJoin(e.select(F.col("n").alias("en"), F.col("d").alias("ed"), "lo", "hi"))
    return rows.select(F.explode(F.array(
        F.struct(F.lit("regions_cover_states").alias("rule"),
                 (F.col("d") == expected_states).alias("passed"),
                 F.col("d").cast("double").alias("observed")),
        F.struct(F.lit("regions_no_duplicate_state").alias("rule"),
                 (F.col("n") == F.col("d")).alias("passed"),
                 (F.col("n") - F.col("d")).cast("double").alias("observed")),
        F.struct(F.lit("ordinals_are_1_to_n").alias("rule"),
                 ((F.col("lo") == 1) & (F.col("hi") == F.col("en"))
                  & (F.col("ed") == F.col("en"))).alias("passed"),
                 F.col("hi").cast("double").alias("observed")),
    )).alias("r")).select("r.*")
