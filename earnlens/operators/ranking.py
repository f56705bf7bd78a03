"""Exact ranks, prefix counts and quantiles without a single-task sort.

A global ``Window.orderBy`` (or Spark's exact ``percentile`` on one big
group) funnels every row of a group through one task. Here rows are first
reduced to distinct (group, value) with map-side combine, and those are dealt
out by ranges of (group, value): a hot group spreads over as many partitions
as its values fill, and each partition holds a contiguous stretch. The
partitions' counts make a small offset table, one row for each group in each
partition; a count below a value is its partition's offset plus a window
inside the partition.

Used by exact medians/quantiles (AGG-17/21/25/26, DST-01, PRF-02, EVA-04),
percentile-in-group (BEN-03), ROC-AUC and average precision (EVA-07/08), and,
for rows instead of values, by the rolling window (WIN-02).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earnlens.session import materialize

G0 = "_g0"
#: The column with the number of a row's range.
PART = "_part"


def _groups(df: DataFrame, groups):
    groups = list(groups or [])
    if not groups:
        df = df.withColumn(G0, F.lit(0))
        groups = [G0]
    return df, groups


def choose_buckets(df: DataFrame, lo: int = 16, hi: int = 4096) -> int:
    """Ranges to deal rows into: the session's shuffle parallelism, clamped
    (``earnlens.rank.buckets`` overrides)."""
    conf = df.sparkSession.conf
    b = conf.get("earnlens.rank.buckets", None) or conf.get("spark.sql.shuffle.partitions", "200")
    return int(min(hi, max(lo, int(b))))


def ranged(df: DataFrame, by: list[str], n: int | None = None) -> DataFrame:
    """``df`` dealt out by ranges of ``by`` and written once, with ``_part``,
    the number of a row's range: numbers ascend with ``by``, and rows with
    equal ``by`` share one. Without ``n`` small ranges are put together."""
    n = n or df.sparkSession.conf.get("earnlens.rank.buckets", None)
    dealt = df.repartitionByRange(int(n), *by) if n else df.repartitionByRange(*by)
    return materialize(dealt.withColumn(PART, F.spark_partition_id()))


def offsets(dealt: DataFrame, groups: list[str], weights: list[str]) -> DataFrame:
    """What the lower ranges of the group sum to: ``groups, _part`` and
    ``{w}_pre`` for each weight; one row for each group in each range."""
    sums = dealt.groupBy(*groups, PART).agg(*[F.sum(w).alias(w) for w in weights])
    lower = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*groups, PART, *[F.coalesce(F.sum(w).over(lower), F.lit(0)).alias(f"{w}_pre") for w in weights])


def distinct_prefix(df: DataFrame, groups, value: str, weights: dict[str, Column],
                    n_buckets: int | None = None) -> DataFrame:
    """One row per (group, distinct value) with, for each weight ``w``:
    ``w`` (sum at this value) and ``w_below`` (sum over strictly smaller
    values in the group). Null values and null groups are ignored."""
    df = df.where(F.col(value).isNotNull())
    df, groups = _groups(df, groups)
    dv = df.groupBy(*groups, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    dv = ranged(dv, [*groups, value], n_buckets)
    inside = Window.partitionBy(PART, *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = offsets(dv, groups, list(weights))
    out = dv.withColumns({f"{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in weights}).join(below, [*groups, PART])
    return out.select(*groups, value, *weights.keys(),
                      *[(F.col(f"{n}_pre") + F.col(f"{n}_in")).alias(f"{n}_below") for n in weights])


def exact_quantiles(df: DataFrame, groups, value: str, probs: dict[str, float],
                    n_buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact linearly-interpolated quantiles (= ``percentile`` /
    ``quantile_cont``) per group: one column per entry of ``probs``.
    Groups with no non-null value are absent. ``weight``: a column with how
    many rows a row stands for."""
    user_groups = list(groups or [])
    base, groups = _groups(df.where(F.col(value).isNotNull()), user_groups)
    count = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    dv = distinct_prefix(base, groups, value, {"_c": count}, n_buckets)
    sizes = dv.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    # the values whose ranks hold the target's lower and upper neighbour
    at = {q: F.lit(float(p)) * (F.col("_n") - 1) for q, p in probs.items()}
    holds = lambda rank: (F.col("_c_below") <= rank) & (rank < F.col("_c_below") + F.col("_c"))
    found = dv.join(sizes, groups).groupBy(*groups, "_n").agg(*[
        F.max(F.when(holds(rank(at[q])), F.col(value))).alias(f"_{i}{side}")
        for i, q in enumerate(probs) for side, rank in (("lo", F.floor), ("hi", F.ceil))])
    between = [(F.col(f"_{i}lo") + (at[q] - F.floor(at[q])) * (F.col(f"_{i}hi") - F.col(f"_{i}lo"))).alias(q) for i, q in enumerate(probs)]
    return found.select(*user_groups, *between)


def exact_quantiles_long(df: DataFrame, groups, values: list[str], probs: dict[str, float],
                         n_buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """Quantiles of several measures in one pass: rows are stacked into
    (measure, _val) first, so the measure is one more group key.
    Output: groups..., measure, one column per prob."""
    kept = [*(groups or []), *([weight] if weight else [])]
    st = df.select(*kept, F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("_val"))
        for v in values])).alias("_m")).select(*kept, "_m.measure", "_m._val")
    return exact_quantiles(st, [*(groups or []), "measure"], "_val", probs, n_buckets, weight)


def exact_median(df: DataFrame, groups, value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, groups, value, {out: 0.5})
