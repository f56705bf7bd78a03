"""Feature drift against a training baseline (SNK-04, DRF-01..03, DRF-05,
DRF-10, WIN-02) as batch jobs; the streaming forms are in
``earnlens.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earnlens.operators.joins import one_row
from earnlens.sources import dims


def _stack(df: DataFrame, features: list[str], fill_missing: bool = False) -> DataFrame:
    cols = []
    for f in features:
        v = F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
        if fill_missing:
            v = F.coalesce(v, F.lit(0.0))
        cols.append(F.struct(F.lit(f).alias("feature"), v.alias("value")))
    return df.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def drift_baseline(df: DataFrame, features: list[str]) -> DataFrame:
    """SNK-04: per feature mean, population std, min, max (4 dp)."""
    s = _stack(df, features)
    return s.groupBy("feature").agg(*[F.round(f("value"), 4).alias(n) for n, f in (
        ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def last_n(df: DataFrame, n: int, order=("ts", "event_id")) -> DataFrame:
    """The rolling window of the last ``n`` observations by arrival order
    (a top-k: each task keeps at most n candidates)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def drift_report(window: DataFrame, baseline: DataFrame,
                 threshold: float = dims.DRIFT_THRESHOLD,
                 min_obs: int = dims.DRIFT_MIN_OBS) -> DataFrame:
    """DRF-01..03/05/10: per baseline feature, z = |window mean - baseline
    mean| / baseline std (std 0 -> z 0); drifted iff z > threshold on the
    unrounded z; z 3 dp, means 2 dp. A missing feature value counts as 0.0.
    Fewer than ``min_obs`` observations -> no feature rows.
    Columns: feature, current_mean, baseline_mean, z_score, drifted,
    window_size, any_drifted."""
    n = window.agg(F.count("*").alias("window_size"), F.lit(0).alias("_k"))
    # stack every baseline feature present in the window (absent -> 0.0)
    bcols = [c for c in window.columns]
    base = baseline.select("feature", F.col("mean").alias("baseline_mean"),
                           F.col("std").alias("baseline_std"))
    st = window.select(F.explode(F.map_entries(F.create_map(*[
        x for c in bcols for x in (F.lit(c), F.col(c).cast("double"))]))).alias("e")
    ).select(F.col("e.key").alias("feature"), F.col("e.value").alias("value"))
    cur = st.groupBy("feature").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("_s"))
    j = base.join(cur, "feature", "left").withColumn("_k", F.lit(0)).join(one_row(n), "_k")
    mean = F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("window_size")
    z = F.when(F.col("baseline_std") == 0, F.lit(0.0)).otherwise(
        F.abs(mean - F.col("baseline_mean")) / F.col("baseline_std"))
    r = j.where(F.col("window_size") >= min_obs).select(
        "feature", F.round(mean, 2).alias("current_mean"),
        F.round("baseline_mean", 2).alias("baseline_mean"), F.round(z, 3).alias("z_score"),
        (z > threshold).alias("drifted"), "window_size")
    return r.withColumn("any_drifted", F.max(F.col("drifted").cast("int"))
                        .over(Window.partitionBy(F.lit(1))) == 1)


def drift_envelope(window: DataFrame, baseline: DataFrame, total: DataFrame,
                   threshold: float = dims.DRIFT_THRESHOLD,
                   min_obs: int = dims.DRIFT_MIN_OBS) -> DataFrame:
    """DRF-02/10: one row about the whole report, also where the window has too
    few observations for one: status ('ok', 'drift' or 'insufficient'),
    window_size, total_observations, n_drifted. ``total``: all observations."""
    r = drift_report(window, baseline, threshold, min_obs)
    n = one_row(r.agg(F.count_if("drifted").alias("n_drifted"), F.lit(0).alias("_k")))
    w = one_row(window.agg(F.count("*").alias("window_size"), F.lit(0).alias("_k")))
    t = total.agg(F.count("*").alias("total_observations"), F.lit(0).alias("_k"))
    status = F.when(F.col("window_size") < min_obs, "insufficient").when(
        F.col("n_drifted") > 0, "drift").otherwise("ok")
    return t.join(w, "_k").join(n, "_k").select(
        status.alias("status"), "window_size", "total_observations", "n_drifted")


def rolling_mean(df: DataFrame, key: str, value: str, n: int = dims.DRIFT_WINDOW,
                 order=("ts", "event_id"), n_buckets: int | None = None, exact: bool = False) -> DataFrame:
    """WIN-02 (batch replay): mean and count of the last ``n`` values per
    key in arrival order (``order``), without putting a hot key in one task.
    ``exact``: the mean of the values' ten decimals, whatever their order.

    A halo exchange over ranges of (key, order):

    1. rows are dealt out by ranges; the offset table tells where in its key
       every range starts;
    2. a row's rank in its key = its range's start + its rank inside;
    3. a range borrows, from the ranges before it in its key, the rows that are
       among its first row's n-1 predecessors: each range offers its own last
       n-1 rows at most, and which range borrows from which is a self-join of
       the offset table;
    4. a ROWS frame of n inside each range over own + borrowed rows, keeping
       own rows only."""
    from earnlens.operators.ranking import PART, offsets, ranged
    from earnlens.session import materialize
    order = list(order)
    rows = ranged(df.select(key, *order, value, F.lit(1).cast("bigint").alias("_1")), [key, *order], n_buckets)
    ends = rows.groupBy(key, PART).agg(F.sum("_1").alias("_size")).join(offsets(rows, [key], ["_1"]), [key, PART])
    # one row for each key in each range, used three times
    ends = materialize(ends.select(key, PART, F.col("_1_pre").alias("_start"), (F.col("_1_pre") + F.col("_size")).alias("_end")))
    inside = Window.partitionBy(PART, key).orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(inside)).join(ends, [key, PART])
    rows = rows.withColumn("_g", F.col("_start") + F.col("_in") - 1).drop("_in", "_1")
    lender = ends.select(key, PART, F.col("_end").alias("_own_end"))
    borrower = ends.select(key, F.col(PART).alias("_to"), F.col("_start").alias("_first"))
    loans = lender.join(borrower, key).where((F.col("_own_end") <= F.col("_first")) & (F.col("_own_end") > F.col("_first") - (n - 1)))
    offered = rows.where(F.col("_g") >= F.col("_end") - (n - 1)).join(loans, [key, PART]).where(F.col("_g") >= F.col("_first") - (n - 1))
    columns = [key, *order, value, "_g"]
    both = rows.select(*columns, PART, F.lit(True).alias("_own")).unionByName(
        offered.select(*columns, F.col("_to").alias(PART), F.lit(False).alias("_own")))
    frame = Window.partitionBy(key, PART).orderBy("_g").rowsBetween(-(n - 1), 0)
    mean = F.avg(F.col(value).cast("decimal(38,10)")).over(frame).cast("double") if exact else F.avg(value).over(frame)
    out = both.withColumns({"rolling_mean": mean, "rolling_n": F.count(value).over(frame)})
    return out.where("_own").select(key, *order, value, "rolling_mean", "rolling_n")
