"""Column rules shared by the operators. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def try_number(col, scale: int = 0) -> Column:
    """Text to decimal, NULL when it is not a number. The default scale rounds cents away,
    as an unscaled NUMBER cast does; ``scale=2`` keeps them."""
    return _c(col).try_cast(f"decimal(38,{scale})")


def trimmed(col) -> Column:
    """Strip all leading and trailing white space, not only spaces."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def blank_to_null(col) -> Column:
    return F.when(_c(col) != "", _c(col))


def split_csv(col) -> Column:
    """Comma list to array: parts trimmed, empty parts dropped, NULL gives an empty array."""
    parts = F.transform(F.split(_c(col), ","), trimmed)
    return F.coalesce(F.filter(parts, lambda part: part != ""), F.array().cast("array<string>"))


def contains_ci(haystack, needle) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the needle are plain characters."""
    return F.contains(F.lower(_c(haystack)), F.lower(_c(needle)))


def valid_npi(col) -> Column:
    """Ten ASCII digits after trimming, otherwise NULL. No check digit."""
    return blank_to_null(F.regexp_extract(_c(col), r"^\s*([0-9]{10})\s*$", 1))


def date_prefix(col) -> Column:
    """Leading YYYY-MM-DD of an ISO text as a date, with no time-zone shift. NULL when the
    text has no such prefix or it is no calendar day."""
    return F.try_to_date(blank_to_null(F.regexp_extract(_c(col), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)))


def compact_date(col) -> Column:
    """CCYYMMDD from a dashed or plain date text."""
    return F.substring(F.regexp_replace(_c(col), "-", ""), 1, 8)


def clip(col, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def short_digest(text) -> Column:
    """First 16 hex characters of the SHA-256 of a text."""
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def as_of(event_cols, asof) -> Column:
    """True when every event date lies strictly before the as-of date. Same-day events are
    foreknowledge and never pass."""
    cond = F.lit(True)
    for event in event_cols:
        cond = cond & (_c(event).cast("date") < _c(asof))
    return cond


def within_lookback(event, asof, months: int = 24) -> Column:
    return _c(event).cast("date") >= F.add_months(_c(asof), -months)


def last_asof_date(event, months: int) -> Column:
    """Last as-of date whose lookback window still holds the event date. ``add_months``
    clamps at month ends, so up to three extra days can map onto the same lower bound."""
    base = F.add_months(_c(event), months)
    best = base
    for extra in (1, 2, 3):
        day = F.date_add(base, extra)
        best = F.when(F.add_months(day, -months) <= _c(event), day).otherwise(best)
    return best


def month_index(day) -> Column:
    return F.year(_c(day)) * 12 + F.month(_c(day))


def sampling_weight(p) -> Column:
    """1/p as a decimal, so that sums do not depend on row order. A missing p counts as 1,
    p <= 0 has no weight (NULL)."""
    prob = F.coalesce(_c(p).cast("double"), F.lit(1.0))
    return F.when(prob > 0, (F.lit(1.0) / F.nullif(prob, F.lit(0.0))).cast("decimal(24,10)"))
