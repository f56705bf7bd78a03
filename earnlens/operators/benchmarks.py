"""Peer benchmarks and context defaults (AGG-25, AGG-26, BEN-01..04,
JOIN-04, JOIN-05, WIN-03).

The reference precomputes dict lookups with sorted income arrays per cell.
Here each is a grouping-level aggregate table (bounded by key cardinality)
joined to the rows that need it; the rank of a value among a cell's incomes
comes from the distributed prefix counts, never from a collected array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earnlens.operators.joins import one_row
from earnlens.operators.ranking import distinct_prefix, exact_quantiles, exact_quantiles_long

CONTEXT = ["employment", "location_quotient", "jobs_per_1000", "hourly_mean"]


def context_defaults(df: DataFrame, state: str = "state", occupation: str = "occupation",
                     measures=CONTEXT) -> DataFrame:
    """AGG-25: medians of the context measures at three levels,
    (state, occupation) -> level 0, (state) -> 1, () -> 3 (the
    ``grouping_id`` numbering). Medians weigh by person rows.

    Rows are counted by (state, occupation, measures) first; only those counts
    are expanded to levels and measures, so that all 3 x len(measures) exact
    medians come from one ranking pass over them."""
    lv = df.groupBy(F.col(state).cast("string").alias("_s"), F.col(occupation).cast("string").alias("_o"),
                    *measures).agg(F.count("*").alias("_w"))
    lv = lv.withColumn("_lv", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))))
    # rows of a null key count in the levels above it only
    lv = lv.where((F.col("_lv") == 3) | (F.col("_s").isNotNull() & ((F.col("_lv") == 1) | F.col("_o").isNotNull())))
    lv = lv.select(F.col("_lv").alias("level"),
                   F.when(F.col("_lv") < 3, F.col("_s")).alias(state),
                   F.when(F.col("_lv") == 0, F.col("_o")).alias(occupation), *measures, "_w")
    # null keys are real group values here (the upper levels)
    lv = lv.fillna({state: "\u0000", occupation: "\u0000"})
    q = exact_quantiles_long(lv, ["level", state, occupation], list(measures), {"med": 0.5}, weight="_w")
    p = q.groupBy("level", state, occupation).pivot("measure", list(measures)).agg(F.first("med"))
    back = lambda c: F.when(F.col(c) != "\u0000", F.col(c)).alias(c)
    return p.select("level", back(state), back(occupation),
                    *[F.col(m).alias(f"med_{m}") for m in measures])


def apply_context_defaults(requests: DataFrame, defaults: DataFrame, state: str = "state",
                           occupation: str = "occupation", measures=CONTEXT) -> DataFrame:
    """JOIN-04/BEN-02: a request's missing context values come from its
    (state, occupation) cell, else its state, else the global row. The
    level is chosen per *cell* (the whole trio of values at once), and only
    a null request value falls back (zero is a real value)."""
    meds = [f"med_{m}" for m in measures]
    pack = lambda lvl, keys: (defaults.where(F.col("level") == lvl).select(
        *keys, F.struct(*meds).alias(f"_d{lvl}")))
    r = requests.join(pack(0, [state, occupation]), [state, occupation], "left")
    r = r.join(pack(1, [state]), [state], "left")
    glob = defaults.where(F.col("level") == 3).select(F.struct(*meds).alias("_d3"),
                                                      F.lit(0).alias("_k"))
    r = r.withColumn("_k", F.lit(0)).join(one_row(glob), "_k", "left").drop("_k")
    d = F.coalesce("_d0", "_d1", "_d3")
    r = r.withColumn("context_level", F.when(F.col("_d0").isNotNull(), 0)
                     .when(F.col("_d1").isNotNull(), 1).otherwise(3))
    r = r.withColumns({m: F.coalesce(F.col(m), d.getField(f"med_{m}")) for m in measures})
    return r.drop("_d0", "_d1", "_d3")


def peer_benchmarks(df: DataFrame, keys=("state", "education_level"),
                    measure: str = "annual_income") -> DataFrame:
    """AGG-26: median, mean, count per (state, education) cell plus a
    global row (keys null) whose count is reported as 0. The global mean is
    that of the cells' exact sums; for the medians rows are counted by (cell,
    value) first, and only those counts are expanded to the two levels."""
    keys = list(keys)
    rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(measure).alias("_v"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    none = [F.lit("\u0000").alias(k) for k in keys]
    cells = rows.groupBy(*keys).agg(F.sum(F.col("_v").cast("decimal(38,10)")).alias("_s"), F.count("_v").alias("_m"), F.count("*").alias("_n"))
    # rows of a null key count in the global row only, whose keys are null
    whole = cells.agg(F.sum("_s").alias("_s"), F.sum("_m").alias("_m"), F.sum("_n").alias("_n")).select(F.lit(1).alias("_lv"), *none, "_s", "_m", "_n")
    agg = cells.where(known).select(F.lit(0).alias("_lv"), *keys, "_s", "_m", "_n").unionByName(whole)
    mean = F.try_divide(F.col("_s").cast("decimal(38,14)"), F.col("_m").cast("decimal(19,0)")).cast("double")
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_w"))
    lv = counts.withColumn("_lv", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("_lv") == 1) | known)
    lv = lv.select("_lv", *[F.when(F.col("_lv") == 0, F.col(k)).otherwise(F.lit("\u0000")).alias(k) for k in keys], "_v", "_w")
    med = exact_quantiles(lv, ["_lv", *keys], "_v", {"median_income": 0.5}, weight="_w")
    j = agg.join(med, ["_lv", *keys], "left")
    back = lambda c: F.when(F.col(c) != "\u0000", F.col(c)).alias(c)
    return j.select(*[back(k) for k in keys], "median_income", mean.alias("mean_income"),
                    F.when(F.col("_lv") == 1, F.lit(0).cast("bigint")).otherwise(F.col("_n"))
                    .alias("group_size"))


def apply_benchmarks(scores: DataFrame, benchmarks: DataFrame,
                     keys=("state", "education_level")) -> DataFrame:
    """JOIN-05/BEN-01: the request's cell, else the global row (size 0)."""
    keys = list(keys)
    cols = ["median_income", "mean_income", "group_size"]
    cell = benchmarks.where(F.col(keys[0]).isNotNull()).select(
        *keys, F.struct(*cols).alias("_cell"))
    glob = benchmarks.where(F.col(keys[0]).isNull()).select(
        F.struct(*cols).alias("_glob"), F.lit(0).alias("_k"))
    r = scores.join(cell, keys, "left")
    r = r.withColumn("_k", F.lit(0)).join(one_row(glob), "_k", "left").drop("_k")
    b = F.coalesce("_cell", "_glob")
    return r.select("*", b.getField("median_income").alias("group_median"),
                    b.getField("mean_income").alias("group_mean"),
                    b.getField("group_size").alias("group_size")).drop("_cell", "_glob")


def with_percentile(scores: DataFrame, incomes: DataFrame, keys=("state", "education_level"),
                    value: str = "predicted", income: str = "annual_income", out: str = "percentile_in_group",
                    n_buckets: int | None = None) -> DataFrame:
    """BEN-03/WIN-03: ``scores`` with 100 x (incomes in the same cell strictly
    below the predicted value) / (incomes in the cell), 1 dp; a cell without
    incomes gives 50.0. The counts below come from the prefix over incomes and
    distinct predictions, and join the score rows by cell and value."""
    keys = list(keys)
    one = lambda df, c, n: df.select(*keys, F.col(c).cast("double").alias("_v"), F.lit(n).cast("bigint").alias("_inc"))
    dv = distinct_prefix(one(incomes, income, 1).unionByName(one(scores, value, 0)), keys, "_v", {"_i": F.col("_inc")}, n_buckets)
    n = dv.groupBy(*keys).agg(F.sum("_i").alias("_n"))
    j = scores.withColumn("_v", F.col(value).cast("double")).join(dv.select(*keys, "_v", "_i_below"), [*keys, "_v"], "left").join(n, keys, "left")
    pct = F.when(F.col("_n").isNull() | (F.col("_n") == 0), F.lit(50.0)).otherwise(
        F.round(F.col("_i_below") * 100.0 / F.col("_n"), 1))
    return j.withColumn(out, pct).drop("_v", "_i_below", "_n")


def percentile_in_group(scores: DataFrame, incomes: DataFrame, keys=("state", "education_level"),
                        value: str = "predicted", income: str = "annual_income",
                        id_col: str = "request_id", n_buckets: int | None = None) -> DataFrame:
    """:func:`with_percentile` of the id, the keys and the value alone."""
    few = scores.select(id_col, *keys, F.col(value).cast("double").alias(value))
    return with_percentile(few, incomes, keys, value, income, n_buckets=n_buckets).select(id_col, *keys, value, "percentile_in_group")


def fallback_mean(means: DataFrame, value: str = "mean") -> DataFrame:
    """BEN-04: unweighted mean of the group means (one row)."""
    return means.agg(F.avg(value).alias("fallback"))
