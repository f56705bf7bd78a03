"""Views of the supplied star-schema tables in the cohort's shape.

The labour-market sources are not supplied, so the analytics run on these
roles (see SURVEY 7.3):

persons   orders x customer x nation x region, one row per order whose status
          is F (Male) or O (Female); income = o_totalprice, education =
          o_orderpriority, occupation = c_mktsegment, state = n_name,
          region = r_name, age = months since 1995-01 of o_orderdate.
wages     per (occupation, state) statistics of all orders, in the shape of
          the state wage table (employment, jobs per 1000, location quotient,
          annual / hourly mean).
cohort    persons >= 100K joined with wages (the integrate job).
requests  every order as a scoring request, before normalisation.

Everything is derived by Spark from the whole tables, so the work grows
with them. Only ``nation`` and ``region`` (fixed-size) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earnlens.operators.joins import small
from earnlens.operators.profile import expectation_rules, judge
from earnlens.sources import dims
from earnlens.sources.tables import read_table

PERSON_COLS = ["person_id", "state", "region", "gender", "age", "education_level",
               "education_ord", "occupation", "annual_income"]
WAGE_COLS = ["occupation", "state", "employment", "jobs_per_1000", "location_quotient",
             "annual_mean_wage", "hourly_mean"]


def _age(c) -> F.Column:
    return ((F.year(c) - 1995) * 12 + F.month(c)).cast("int")


def customers_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x nation x region: (custkey, occupation, state, region)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    geo = nation.join(small(region, 10_000), nation.n_regionkey == region.r_regionkey)
    return (cust.join(small(geo.select("n_nationkey", "n_name", "r_name"), 10_000),
                      cust.c_nationkey == F.col("n_nationkey"))
            .select(F.col("c_custkey"), F.col("c_mktsegment").alias("occupation"),
                    F.col("n_name").alias("state"), F.col("r_name").alias("region")))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed persons table (written once, then read)."""
    from earnlens.sources.store import processed
    return processed(spark, "persons", sf_dir, lambda: build_persons(spark, sf_dir))


def wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed wage table (written once, then read)."""
    from earnlens.sources.store import processed
    return processed(spark, "wages", sf_dir, lambda: build_wages(spark, sf_dir))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort table (written once by the integrate job, then read)."""
    from earnlens.sources.store import processed
    return processed(spark, "cohort", sf_dir, lambda: build_cohort_table(spark, sf_dir), observe=expectation_rules(**COHORT_RULES)[0])


#: What the cohort has to meet (DQ-02..07); observed while it is written.
COHORT_RULES = dict(not_null=("annual_income", "state"), row_range=(5000, 50000), distinct_eq=("state", 25),
                    min_floor=("annual_income", 100000), positive=("location_quotient", "employment"),
                    in_range={"age": (16, 100), "education_ord": (1, 5)}, in_set={"gender": ("Male", "Female")})


def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-02..07 of the cohort table, from the scan of the job that wrote it."""
    from earnlens.sources.store import observed
    cohort(spark, sf_dir)
    return judge(observed(spark, "cohort", sf_dir), expectation_rules(**COHORT_RULES)[1])


def build_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (read_table(spark, sf_dir, "orders")
              .where(F.col("o_orderstatus").isin("F", "O")))
    # orders x customer is a large-large equi join: no hint, Catalyst/AQE
    # picks sort-merge (or broadcast at runtime when customer is small).
    j = orders.join(customers_located(spark, sf_dir), orders.o_custkey == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("person_id"),
        "state", "region",
        F.when(F.col("o_orderstatus") == "F", "Male").otherwise("Female").alias("gender"),
        _age(F.col("o_orderdate")).alias("age"),
        F.col("o_orderpriority").alias("education_level"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("education_ord"),
        "occupation",
        F.col("o_totalprice").alias("annual_income"),
    )


def build_wages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-(occupation, state) wage statistics over all orders."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    j = orders.join(customers_located(spark, sf_dir), orders.o_custkey == F.col("c_custkey"))
    from earnlens.functions.metrics import exact_mean
    cells = j.groupBy("occupation", "state").agg(
        F.count("*").alias("n"), exact_mean("o_totalprice").alias("annual_mean_wage"))
    # The cell table is bounded by #occupations x #states, so the three
    # marginal totals are taken with windows over it.
    from pyspark.sql import Window
    n_state = F.sum("n").over(Window.partitionBy("state"))
    n_occ = F.sum("n").over(Window.partitionBy("occupation"))
    n_all = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return cells.select(
        "occupation", "state",
        F.col("n").cast("double").alias("employment"),
        (F.lit(1000.0) * F.col("n") / n_state).alias("jobs_per_1000"),
        ((F.col("n") / n_state) / (n_occ / n_all)).alias("location_quotient"),
        "annual_mean_wage",
        (F.col("annual_mean_wage") / dims.HOURS_PER_YEAR).alias("hourly_mean"),
    )


def build_cohort_table(spark: SparkSession, sf_dir: str,
                       floor: float = dims.MIN_ANNUAL_INCOME) -> DataFrame:
    """The integrate job (JOIN-01 + FLT-04 + DED-01) from the raw tables."""
    from earnlens.operators.integrate import build_cohort
    return build_cohort(build_persons(spark, sf_dir), build_wages(spark, sf_dir), floor=floor)


def requests(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Every order as a raw scoring request (un-normalised text, optional
    context absent). Status P has no gender, so those requests fail DQ-09,
    as do ages under 18. ``orders`` may be a stream (stream-static join)."""
    orders = orders if orders is not None else read_table(spark, sf_dir, "orders")
    j = orders.join(customers_located(spark, sf_dir), orders.o_custkey == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").alias("request_id"),
        F.lower("state").alias("state"),
        "occupation",
        F.col("o_orderpriority").alias("education_level"),
        F.when(F.col("o_orderstatus") == "F", " male")
         .when(F.col("o_orderstatus") == "O", "FEMALE ")
         .otherwise("n/a").alias("gender"),
        _age(F.col("o_orderdate")).alias("age"),
        F.lit(None).cast("double").alias("employment"),
        F.lit(None).cast("double").alias("location_quotient"),
        F.lit(None).cast("double").alias("jobs_per_1000"),
        F.lit(None).cast("double").alias("hourly_mean"),
    )


def education(spark: SparkSession) -> DataFrame:
    return dims.education_dim(spark, dims.TESTBED_EDUCATION_ORDER)


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.testbed_region_dim(read_table(spark, sf_dir, "nation"),
                                   read_table(spark, sf_dir, "region"))


#: Nations that stand for areas outside the states (FLT-02).
AREA_OF_NATION = dict(zip((3, 7, 11, 19), dims.EXCLUDED_AREAS))


def raw_wages(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: D401
    """The wage statistics rendered as the raw text table (SRC-01 shape):
    area names lower-cased and padded, codes hyphenated, and the release
    markers a statistics office uses: '**' where a cell's share is too
    small to publish (jobs per 1000 < 180) and '#' for top-coded wages
    (annual mean >= 262000)."""
    w = wages(spark, sf_dir)
    nation = read_table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    w = w.join(small(nation, 10_000), w.state == F.col("n_name"))
    code = F.concat(F.lpad(F.length("occupation").cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(F.ascii("occupation").cast("string"), 4, "0"))
    top = F.col("annual_mean_wage") >= 262000
    return w.select(
        F.concat(F.lit(" \t"), F.lower("state"), F.lit("\n ")).alias("AREA_TITLE"),
        F.coalesce(F.create_map(*[F.lit(x) for kv in AREA_OF_NATION.items() for x in kv])[F.col("n_nationkey").cast("int")],
                   F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("PRIM_STATE"),
        F.format_string("%.4f", "location_quotient").alias("LOC_QUOTIENT"),
        code.alias("OCC_CODE"),
        F.concat(F.lower("occupation"), F.lit(" first-line workers")).alias("OCC_TITLE"),
        F.when(F.col("jobs_per_1000") < 180, F.lit("**"))
         .otherwise(F.format_string("%.0f", "employment")).alias("TOT_EMP"),
        F.format_string("%.4f", "jobs_per_1000").alias("JOBS_1000"),
        F.when(top, F.lit("#")).otherwise(F.format_string("%.2f", "hourly_mean")).alias("H_MEAN"),
        F.when(top, F.lit("#")).otherwise(F.format_string("%.2f", "annual_mean_wage")).alias("A_MEAN"),
    )


def raw_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as raw person microdata (SRC-02 shape, integer codes):
    STATEICP = nation key; EDUCD = 100 + priority digit (101..105, of which
    105 has no label and is dropped by cleaning); DEGFIELDD = the segment's
    first character code; OCCSOC = segment prefix + '-' + customer key (the
    first digit run is the code); SEX 1/2 for F/O and 3 otherwise (kept as
    text by the pass-through recode); INCTOT whole dollars; AGE in months."""
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey)
    return j.select(
        F.col("c_nationkey").cast("int").alias("STATEICP"),
        F.ascii("c_mktsegment").cast("int").alias("DEGFIELDD"),
        (F.lit(100) + F.substring("o_orderpriority", 1, 1).cast("int")).alias("EDUCD"),
        F.concat(F.substring("c_mktsegment", 1, 2), F.lit("-"), F.col("c_custkey").cast("string")).alias("OCCSOC"),
        F.floor("o_totalprice").cast("long").alias("INCTOT"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
         .otherwise(3).alias("SEX"),
        _age(F.col("o_orderdate")).alias("AGE"))


def person_dims(spark: SparkSession, sf_dir: str):
    """(state_dim, education_dim, degree_dim) for ``raw_persons``."""
    state = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("STATEICP"), F.col("n_name").alias("STATE"))
    edu = spark.createDataFrame([(100 + v, k) for k, v in dims.TESTBED_EDUCATION_ORDER.items()
                                 if v <= 4], "EDUCD int, EDUCATION string")
    deg = (read_table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
           .select(F.ascii("c_mktsegment").cast("int").alias("DEGFIELDD"),
                   F.col("c_mktsegment").alias("DEGREE")))
    return state, edu, deg
