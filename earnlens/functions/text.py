"""Text cleaning and recoding expressions (PRJ-04..08, PRJ-12, PRJ-15, PRJ-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of a text's ends, as Python's ``strip()`` takes it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# A plain decimal or scientific literal, optional sign and surrounding blanks.
# Anything else ('*', '#', '1,234', 'inf', '1d') becomes null, as a
# coerce-to-number on text would leave it.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c) -> Column:
    """Without white space at both ends."""
    return F.btrim(_c(c), F.lit(SPACES))


def to_number(c) -> Column:
    """Text -> double; invalid text -> null (PRJ-04)."""
    c = _c(c).cast("string")
    return F.when(c.rlike(NUMERIC_TEXT), stripped(c).try_cast("double"))


def title_case(c) -> Column:
    """``strip()`` then Python-style ``title()`` (PRJ-05).

    Each letter that follows a non-letter is upper-cased, all others
    lower-cased: ``first-line o'neil`` -> ``First-Line O'Neil``. ``initcap``
    alone only capitalises after blanks, so the text is split after every
    non-letter and each piece is ``initcap``-ed.
    """
    pieces = F.split(F.lower(stripped(c)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda t: F.initcap(t)), "")


def strip_hyphens(c) -> Column:
    """Literal hyphen removal (PRJ-06)."""
    return F.regexp_replace(_c(c), "-", "")


def first_digits(c, width: int = 6) -> Column:
    """First run of digits, left-padded with zeros to ``width``; no digits ->
    null; longer runs are kept whole (PRJ-07)."""
    d = F.regexp_extract(_c(c).cast("string"), r"(\d+)", 1)
    return (F.when(d == "", F.lit(None).cast("string"))
            .when(F.length(d) < width, F.lpad(d, width, "0"))
            .otherwise(d))


def recode(c, mapping: dict, keep: bool = True) -> Column:
    """Recode through a literal map. ``keep`` passes unknown values through as
    text (PRJ-08); otherwise unknown -> null."""
    if not mapping:
        return _c(c).cast("string") if keep else F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in (str(kv[0]), kv[1])])
    key = _c(c).cast("string")
    return F.coalesce(m[key], key) if keep else m[key]


def shorten(c, n: int = 30) -> Column:
    """Label truncation to ``n`` characters plus '...' (PRJ-15)."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def education_bucket(c) -> Column:
    """Advanced / Bachelor / Lower from a free-text education label (PRJ-12).

    Null labels fall into Lower, as in the reference (text 'nan')."""
    low = F.lower(F.coalesce(_c(c).cast("string"), F.lit("nan")))
    adv = (low.contains("phd") | low.contains("doctor")
           | low.contains("professional") | low.contains("master"))
    return (F.when(adv, F.lit("Advanced"))
            .when(low.contains("bachelor"), F.lit("Bachelor"))
            .otherwise(F.lit("Lower")))


def normalise_state(c) -> Column:
    """Request state code: trimmed, upper case (PRJ-16)."""
    return F.upper(stripped(c))


def normalise_gender(c) -> Column:
    """Request gender: trimmed, title case (PRJ-16); validity is DQ-09."""
    return F.initcap(stripped(c))


def epoch_micros(c, dtype: str) -> Column:
    """Microseconds since 1970-01-01 of a time column, independent of the
    session time zone: a naive (``timestamp_ntz``) wall clock is read as UTC
    by plain arithmetic; an instant (``timestamp``) uses ``unix_micros``."""
    c = _c(c)
    if dtype.startswith("timestamp_ntz"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if dtype.startswith("timestamp"):
        return F.unix_micros(c)
    return c.cast("long")
