"""Cleaning rules on dirty raw rows (FIXTURES B7)."""

from pyspark.sql import functions as F

from earnlens.functions.text import education_bucket, first_digits, recode, shorten, title_case, to_number
from earnlens.operators import clean as cl
from earnlens.operators.integrate import build_cohort, duplicate_count


def test_text_functions(spark):
    df = spark.createDataFrame([("  north carolina ", "first-line supervisors", "1191XX"),
                                ("women's health", "o'neil-smith", "XX"),
                                ("a", "b", "15-1252"), ("x", "y", "1234567")],
                               "a string, b string, c string")
    r = df.select(title_case("a").alias("a"), title_case("b").alias("b"),
                  first_digits("c").alias("c")).collect()
    assert r[0].a == "North Carolina" and r[0].b == "First-Line Supervisors" and r[0].c == "001191"
    assert r[1].a == "Women'S Health" and r[1].b == "O'Neil-Smith" and r[1].c is None
    assert r[2].c == "000015" and r[3].c == "1234567"


def test_to_number_and_recode(spark):
    df = spark.createDataFrame([("*",), ("#",), ("1,234",), (" 12.5 ",), ("1e3",), ("inf",), ("1d",)], "x string")
    assert [r.v for r in df.select(to_number("x").alias("v")).collect()] == \
        [None, None, None, 12.5, 1000.0, None, None]
    s = spark.createDataFrame([(1,), (2,), (3,)], "s int")
    assert [r.g for r in s.select(recode("s", {1: "Male", 2: "Female"}).alias("g")).collect()] == \
        ["Male", "Female", "3"]


def test_bucket_and_shorten(spark):
    df = spark.createDataFrame([("Doctoral degree",), ("Master's degree",), ("Bachelor's degree",),
                                ("High school",), (None,)], "x string")
    assert [r.b for r in df.select(education_bucket("x").alias("b")).collect()] == \
        ["Advanced", "Advanced", "Bachelor", "Lower", "Lower"]
    t = spark.createDataFrame([("x" * 31,), ("short",)], "x string").select(shorten("x").alias("y")).collect()
    assert t[0].y == "x" * 30 + "..." and t[1].y == "short"


def test_clean_wages_rules(spark):
    cols = "AREA_TITLE string, PRIM_STATE string, LOC_QUOTIENT string, OCC_CODE string, " \
           "OCC_TITLE string, TOT_EMP string, JOBS_1000 string, H_MEAN string, A_MEAN string"
    rows = [("  north carolina ", "NC", "1.2", "11-1011", "chief executives", "100", "1.0", "48.08", "99999"),
            ("texas", "TX", "1.0", "11-1021", "managers", "100", "1.0", None, "120000"),
            ("district of columbia", "DC", "1.0", "11-1011", "ceo", "100", "1.0", "90", "190000"),
            ("ohio", "OH", "*", "11-1011", "ceo", "100", "1.0", "90", "190000"),
            ("iowa", "IA", "1.0", "11-1011", "ceo", "100", "1.0", "40", "90000")]
    out = cl.clean_wages(spark.createDataFrame(rows, cols)).collect()
    assert [(r.STATE, r.OCC_CODE) for r in out] == [("North Carolina", "111011")]


def test_build_cohort_joins_and_dedupes(spark):
    p = spark.createDataFrame([(1, "A", "S", 150000.0), (1, "A", "S", 150000.0), (2, "B", "S", 90000.0),
                               (3, "C", "S", 200000.0)],
                              "person_id int, occupation string, state string, annual_income double")
    w = spark.createDataFrame([("A", "S", 5.0), ("B", "S", 6.0)], "occupation string, state string, employment double")
    c = build_cohort(p, w)
    assert c.count() == 1 and c.first().employment == 5.0
    d = duplicate_count(p).first()
    assert (d.rows, d.distinct_rows, d.duplicate_rows) == (4, 3, 1)
