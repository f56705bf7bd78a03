"""Deterministic hashing: splits, folds, samples, payload keys, fingerprints.

All of these depend on row content only, never on partitioning or file
layout, so membership is stable across runs and cluster sizes and the same
formula can be written in any SQL engine that has ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_unit(key, seed: int = 42, modulus: int = 100) -> Column:
    """First 32 bits of md5(key || '|' || seed) modulo ``modulus`` (bigint)."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(modulus)


def hash_rank_key(key, seed: int = 42) -> Column:
    """A 32-bit pseudo-random integer per key, for seeded ordering/sampling."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def payload_hash(cols: list[str], n_hex: int = 16) -> Column:
    """Canonical key of a normalised request: JSON of the fields in sorted
    name order, SHA-256, first ``n_hex`` hex characters (SCO-07)."""
    s = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
    return F.substring(F.sha2(s, 256), 1, n_hex)


def row_digest(cols: list[str]) -> Column:
    """md5 of a row's columns joined with '|' (nulls as the text 'NULL').
    Callers format doubles first (``fixed2``) so all engines agree."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def fixed2(c) -> Column:
    """Double rendered with exactly two decimals, engine independent."""
    return F.regexp_replace(F.format_number(_c(c), 2), ",", "")
