"""Differences of dates that count crossed boundaries, as DATE_DIFF does in the plan language."""

from __future__ import annotations

import logging

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("day", "hour", "month", "year")


def unit_name(unit: str) -> str:
    """The unit without a plural s; one that isn't known counts as day, with a warning."""
    name = unit.strip().lower().removesuffix("s")
    if name not in UNITS:
        logging.getLogger(__name__).warning("unknown unit %r: days are counted", unit)
        return "day"
    return name


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit between two dates or zone-less timestamps, negative if the end is first; null if either is."""
    name = unit_name(unit)
    if name == "year":
        out = F.year(end) - F.year(start)
    elif name == "month":
        out = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    elif name == "day":
        out = F.datediff(F.to_date(end), F.to_date(start))
    else:
        out = F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))
    return out.cast("long")
