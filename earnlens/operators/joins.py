"""Join helpers: size-checked broadcast and dimension lookups (JOIN-02,
JOIN-03, JOIN-07, JOIN-08).

Broadcast policy
----------------
* base/dimension tables: ``small()`` checks the row count with a bounded
  ``limit(n+1).count()`` on the scan, then hints ``broadcast`` or not;
* one-row global aggregates: ``one_row()`` (bounded by construction);
* derived per-key aggregates: no hint. AQE re-plans after the aggregate's
  shuffle stage and turns the join into a broadcast hash join when the
  measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``,
  else keeps sort-merge, splitting skewed partitions. A size check on a
  derived frame would run its whole lineage an extra time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows a lookup side may have and still be broadcast, and bytes that so many
# rows of its columns (by Spark's estimate of their types) may take. Checked per
# call with a bounded count (the scan stops after one row too many).
DEFAULT_BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


_FITS: dict = {}


def fits(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and these take at most
    ``BROADCAST_BYTES`` (a bounded action, remembered per session for
    semantically equal plans)."""
    max_rows = min(max_rows, BROADCAST_BYTES // max(1, df._jdf.schema().defaultSize()))
    try:
        key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), max_rows)
    except Exception:  # noqa: BLE001
        key = None
    if key is not None and key in _FITS:
        return _FITS[key]
    ok = df.limit(max_rows + 1).count() <= max_rows
    if key is not None:
        _FITS[key] = ok
    return ok


def small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when its row count is proven below ``max_rows``;
    otherwise the plain frame, leaving the join strategy to Catalyst/AQE
    (sort-merge with skew-join splitting)."""
    return F.broadcast(df) if fits(df, max_rows) else df


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a global (ungrouped) aggregate: it has exactly one row by
    construction, so its size is proven without a check."""
    return F.broadcast(df)


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "left",
           max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Code/label lookup; a miss gives null (``how='left'``)."""
    return df.join(small(dim, max_rows), on, how)


def lookup_with_default(df: DataFrame, means: DataFrame, key: str, value: str,
                        out: str, default: Column | float | None) -> DataFrame:
    """Left lookup + constant fallback for misses (JOIN-03)."""
    m = means.select(F.col(key).cast("string").alias("__k"), F.col(value).alias("__v"))
    # ``means`` is a per-key aggregate: AQE broadcasts it at runtime when its
    # shuffle output is small, else sort-merge with skew splitting.
    j = df.join(m, F.col(key).cast("string") == F.col("__k"), "left")
    d = default if isinstance(default, Column) else F.lit(default)
    return j.withColumn(out, F.coalesce(F.col("__v"), d).cast("double")).drop("__k", "__v")


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Membership filter (JOIN-07/FLT-07); ``keys`` is usually a top-k
    (bounded by k), which AQE broadcasts at runtime."""
    return df.join(keys, on, "left_semi")

