"""Metric expressions used inside aggregates (EVA-02, EVA-05, SCO-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pinball(y, yhat, alpha: float) -> Column:
    """Per-row pinball loss max(a*e, (a-1)*e), e = y - yhat; average it."""
    e = _c(y) - _c(yhat)
    return F.greatest(F.lit(alpha) * e, F.lit(alpha - 1.0) * e)


def crossed(p10, p50, p90) -> Column:
    """True when the quantile trio is out of order (before clamping)."""
    return (_c(p10) > _c(p50)) | (_c(p50) > _c(p90))


def clamp_trio(p10, p50, p90) -> tuple[Column, Column, Column]:
    """p10 = min, p90 = max of the trio; p50 limited to [p10, p90]."""
    lo = F.least(_c(p10), _c(p50), _c(p90))
    hi = F.greatest(_c(p10), _c(p50), _c(p90))
    mid = F.least(F.greatest(_c(p50), lo), hi)
    return lo, mid, hi


def exact_mean(c, scale: int = 10) -> Column:
    """Mean as the double nearest to the exact decimal mean: values are
    summed as decimal(38, scale) (exact, independent of partitioning and
    summation order), then divided. A plain double sum can land a few ulps
    beside a half-way value and round the other way (means of cent amounts
    often sit exactly on a half at the 5th decimal)."""
    return F.avg(_c(c).cast(f"decimal(38,{scale})")).cast("double")


def cents(c) -> Column:
    """Rounded to cents through four exact decimals: half a cent goes up
    whatever the double nearest to it is."""
    return F.round(_c(c).cast("decimal(20,4)"), 2).cast("double")
