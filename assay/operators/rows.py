"""Operators that look at one row at a time: NORMALIZE, FILTER, DATE_DIFF, THRESHOLD, COMPLETENESS.

They run on streaming DataFrames as well.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame

from assay.functions import dates
from assay.functions.casts import to_type
from assay.plans.model import Completeness, DateDiff, Filter, Normalize, PlanError, Threshold

from .base import Context, column, expression, operator, pre_filter, tagged


@operator("NORMALIZE")
def normalize(step: Normalize, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """The dataset's schema columns, cast to their types; all columns as they are if it has no schema."""
    if step.dataset not in ctx.datasets:
        raise PlanError(f"step {step.id}: dataset {step.dataset!r} is not there")
    df, schema = ctx.datasets[step.dataset], ctx.schemas.get(step.dataset)
    if not schema:
        return df
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    if missing := [n for n in schema if n.lower() not in kinds]:
        raise PlanError(f"step {step.id}: dataset {step.dataset!r} has no column {', '.join(missing)}")
    trimmed = step.dataset in ctx.stripped
    return df.select(*[to_type(column(df, n), kinds[n.lower()], t, trimmed).alias(n) for n, t in schema.items()])


@operator("FILTER")
def filter_rows(step: Filter, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Rows for which all conditions hold (null is no), with the check's tags."""
    holds = reduce(lambda a, b: a & b, [expression(c, ctx) for c in step.conditions])
    df = env[step.input].where(holds)
    if step.check_id:
        return tagged(df, check_id=step.check_id, reason=f"Violation detected by {step.check_id}", _check_id=step.check_id)
    return tagged(df, _check_id="")


@operator("DATE_DIFF")
def date_diff(step: DateDiff, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Appends the boundaries of a unit between two fields; a pre-filter removes rows."""
    df = pre_filter(env[step.input], step.filter)
    name = f"{step.from_field}_to_{step.to_field}_{dates.unit_name(step.unit)}s"
    return df.withColumn(name, dates.date_diff(step.unit, column(df, step.from_field), column(df, step.to_field)))


@operator("THRESHOLD")
def threshold(step: Threshold, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Appends whether the condition holds: true, false or null. All rows stay."""
    return env[step.input].withColumn(step.flag_field, expression(step.condition, ctx))


@operator("COMPLETENESS")
def completeness(step: Completeness, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Rows, of those that pass the pre-filter, in which the field is null."""
    df = pre_filter(env[step.input], step.filter)
    df = df.where(column(df, step.check_field).isNull())
    return tagged(df, check_id=step.check_id, reason=f"Required field {step.check_field} is NULL or missing")
