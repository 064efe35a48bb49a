"""Casts of the schema vocabulary. They never fail: what can't be read is null.

Text is read as the plan language's own engine does, which differs from Spark's casts in a few forms; see each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "boolean": T.BooleanType(),
}


def _dashed(c: Column) -> Column:
    """2026/01/05 as 2026-01-05."""
    return F.regexp_replace(c, r"^(\s*\d+)/(\d{1,2})/", "$1-$2-")


def to_integer(c: Column, kind: T.DataType) -> Column:
    """Numbers are rounded: halves of text away from zero, halves of doubles to even."""
    if isinstance(kind, T.StringType):
        wide = F.round(c.try_cast("decimal(38,18)"), 0).try_cast("bigint")
        return F.coalesce(c.try_cast("bigint"), wide)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.rint(c).try_cast("bigint")
    return c.try_cast("bigint")


def to_float(c: Column, kind: T.DataType) -> Column:
    """Text with a type suffix (1d, 2.5f) is no number."""
    if isinstance(kind, T.StringType):
        return F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c.try_cast("double"))
    return c.try_cast("double")


def to_date(c: Column, kind: T.DataType) -> Column:
    """Text needs year, month and day, between dashes or slashes."""
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r"^\s*\d+([-/])\d{1,2}\1\d{1,2}"), _dashed(c).try_cast("date"))
    return c.try_cast("date")


def to_datetime(c: Column, kind: T.DataType) -> Column:
    """As for dates."""
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r"^\s*\d+([-/])\d{1,2}\1\d{1,2}"), _dashed(c).try_cast("timestamp_ntz"))
    return c.try_cast("timestamp_ntz")


def to_type(c: Column, kind: T.DataType, target: str, trimmed: bool = False) -> Column:
    """A column of Spark type ``kind`` as a type of the schema vocabulary; others pass. ``trimmed``: no blanks need to go."""
    if target == "string":
        text = c if isinstance(kind, T.StringType) else c.cast("string")
        return text if trimmed else F.trim(text)
    casts = {"integer": to_integer, "float": to_float, "date": to_date, "datetime": to_datetime}
    if target in casts:
        return casts[target](c, kind)
    if target == "boolean":
        return c.try_cast("boolean")
    return c
