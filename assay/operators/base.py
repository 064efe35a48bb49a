"""What operators share: the context they run in, the registry, pre-filters and tags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.translate import quoted, translate
from assay.plans.model import COMPARISONS, PlanError, PreFilter, Step

#: Columns that terminal steps add; they are made anew by every one, so that the outermost step's hold.
TAGS = ("result_type", "check_id", "reason", "_check_id")


@dataclass
class Context:
    """Datasets and their schemas (column -> type of the schema vocabulary), the day that counts as today, and how columns of
    the right side of a join are renamed: ``per_name`` counts each name, ``running`` counts all collisions of a join."""

    datasets: Mapping[str, DataFrame] = field(default_factory=dict)
    schemas: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    as_of: dt.date | dt.datetime | None = None
    collision_naming: str = "per_name"
    #: Datasets whose text our own ingestion has stripped already, so that filters on it reach the files.
    stripped: frozenset[str] = frozenset()


Operator = Callable[[Step, Mapping[str, DataFrame], Context], DataFrame]
REGISTRY: dict[str, Operator] = {}


def operator(kind: str) -> Callable[[Operator], Operator]:
    """Registers the function that makes a step's DataFrame from those of earlier steps."""

    def register(f: Operator) -> Operator:
        REGISTRY[kind] = f
        return f

    return register


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever signs that has."""
    return df[quoted(name)]


def expression(text: str, ctx: Context) -> Column:
    return F.expr(translate(text, ctx.as_of))


def pre_filter(df: DataFrame, spec: PreFilter | None) -> DataFrame:
    """Rows for which field, comparison and literal hold; all of them without a pre-filter."""
    if spec is None:
        return df
    sign = COMPARISONS.get(spec.op, str(spec.op).upper())
    c, value = column(df, spec.field), F.lit(spec.value)
    holds = {
        "=": lambda: c == value, "==": lambda: c == value, "<>": lambda: c != value, "!=": lambda: c != value, ">": lambda: c > value,
        "<": lambda: c < value, ">=": lambda: c >= value, "<=": lambda: c <= value, "LIKE": lambda: c.like(spec.value), "ILIKE": lambda: c.ilike(spec.value),
    }.get(sign)
    if holds is None:
        raise PlanError(f"unknown comparison {spec.op!r}")
    return df.where(holds())


def tagged(df: DataFrame, **tags: str | None) -> DataFrame:
    """Without the tags of earlier steps, and with these after the other columns; None is a null text."""
    out = df.drop(*TAGS)
    return out.withColumns({k: F.lit(v).cast("string") for k, v in tags.items()})
