"""Calendar columns: month arithmetic, buckets, cyclic features, stamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter")

# ---- fixed values: periods of the cyclic features ----------------------------------
DAYS_OF_WEEK = 7
MONTHS_OF_YEAR = 12
ISO_WEEKS = 53
# -------------------------------------------------------------------------------------


def bucket_date(ts: Column, grain: str) -> Column:
    """First day of the day, ISO week (Monday), month or quarter."""
    if grain not in GRAINS:
        raise ValueError(f"grain {grain!r} is not one of {GRAINS}")
    return F.to_date(F.date_trunc(grain, ts))


def month_index(day: Column) -> Column:
    """Months since year 0, so that differences count months."""
    return F.year(day) * 12 + F.month(day) - 1


def month_key(day: Column) -> Column:
    """``yyyyMM`` text of a date."""
    return F.date_format(day, "yyyyMM")


def key_to_month(key: Column) -> Column:
    """First day of a ``yyyyMM`` text."""
    return F.to_date(key, "yyyyMM")


def last_complete_month(today: Column) -> Column:
    """``yyyyMM`` of the month before the current, still partial one."""
    return month_key(F.add_months(today, -1))


def stamp_to_date(stamp: Column) -> Column:
    """Date of a 14-digit ``yyyyMMddHHmmss`` stamp; null when malformed."""
    return F.to_date(F.try_to_timestamp(F.substring(stamp, 1, 8), F.lit("yyyyMMdd")))


def parse_instant(text: Column) -> Column:
    """ISO instant with zone and up to nanosecond digits; kept to the microsecond.

    Text without a zone is read as UTC.
    """
    trimmed = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    zoned = F.when(trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), trimmed).otherwise(
        F.concat(trimmed, F.lit("Z"))
    )
    return F.try_to_timestamp(zoned)


def cyclic_features(day: Column, unit: str = "day") -> dict[str, Column]:
    """Sine and cosine of the position in the week, year and ISO week of a target date."""

    def pair(name: str, position: Column, period: int) -> dict[str, Column]:
        angle = position * (2 * math.pi) / period
        return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}

    month = pair("month", F.month(day), MONTHS_OF_YEAR)
    if unit == "month":
        return month
    return {
        **pair("dow", F.weekday(day), DAYS_OF_WEEK),
        **month,
        **pair("isoweek", F.weekofyear(day), ISO_WEEKS),
        "is_weekend": (F.weekday(day) >= 5).cast("double"),
    }
