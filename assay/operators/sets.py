"""Operators that look at several rows or inputs: JOIN, AGGREGATE, UNIQUENESS, RECONCILIATION."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.translate import is_bare_aggregate, translate
from assay.plans.model import Aggregate, Join, PlanError, Reconciliation, Uniqueness

from .base import TAGS, Context, column, operator, tagged


def renamed_right(left: list[str], right: list[str], naming: str = "per_name") -> list[str]:
    """Names of the right side's columns: ones that are taken get a number, the left side's stay."""
    taken, count, out = {n.lower() for n in left}, 0, []
    for n in right:
        new = n
        if n.lower() in taken:
            count = count + 1 if naming == "running" else 1
            new = f"{n}_{count}"
            while new.lower() in taken:
                count += 1
                new = f"{n}_{count}"
        taken.add(new.lower())
        out.append(new)
    return out


@operator("JOIN")
def join(step: Join, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Equi-join on one key of each side. All columns of both stay, both keys too; null keys match nothing.

    No strategy is forced: Catalyst broadcasts a side whose size it knows to be small, and adaptive execution splits hot keys.
    """
    left, right = env[step.left].drop(*TAGS), env[step.right].drop(*TAGS)
    at = [c.lower() for c in right.columns].index(step.right_key.lower()) if step.right_key.lower() in [c.lower() for c in right.columns] else None
    if at is None:
        raise PlanError(f"step {step.id}: {step.right!r} has no column {step.right_key!r}")
    names = renamed_right(left.columns, right.columns, ctx.collision_naming)
    right = right.toDF(*names)
    return left.join(right, column(left, step.left_key) == column(right, names[at]), step.join_type)


@operator("AGGREGATE")
def aggregate(step: Aggregate, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """One row of metrics over all rows, or one for each group of ``group_by``."""
    metrics = []
    for m in step.metrics:
        formula = translate(m.formula, ctx.as_of)
        if m.filter:
            if not is_bare_aggregate(m.formula):
                raise PlanError(f"step {step.id}: metric {m.name!r} has a filter, so its formula must be one aggregate call")
            formula = f"{formula} FILTER (WHERE {translate(m.filter, ctx.as_of)})"
        metrics.append(F.expr(formula).alias(m.name))
    df = env[step.input]
    out = df.groupBy(*[column(df, g) for g in step.group_by]).agg(*metrics) if step.group_by else df.agg(*metrics)
    return out.select(F.lit(step.check_id).cast("string").alias("check_id"), "*")


@operator("UNIQUENESS")
def uniqueness(step: Uniqueness, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """All rows whose keys occur more than once, with how often; null keys are equal to each other.

    Keys are counted before the shuffle and joined back null-safely: a hot key is a few partial counts and a join partition
    that adaptive execution splits, where a window would put all its rows in one task.
    """
    df = env[step.input].drop("_dup_count")
    keys = [column(df, k) for k in step.key_columns]
    names = [f"__key_{i}" for i in range(len(keys))]
    counts = df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_dup_count")).where("_dup_count > 1")
    same = [k.eqNullSafe(counts[n]) for k, n in zip(keys, names, strict=True)]
    out = df.join(counts, same, "inner").drop(*names)
    return tagged(out, check_id=step.check_id, reason=f"Duplicate row detected on key columns: {', '.join(step.key_columns)}")


@operator("RECONCILIATION")
def reconciliation(step: Reconciliation, env: Mapping[str, DataFrame], ctx: Context) -> DataFrame:
    """Rows of the left side whose key the right side lacks; null keys are lacking, repeated rows stay."""
    left = env[step.left]
    keys = env[step.right].select(column(env[step.right], step.right_key).alias("__key"))
    out = left.join(keys, column(left, step.left_key) == F.col("__key"), "left_anti")
    return tagged(out, check_id=step.check_id, reason=f"Record present in {step.left} but absent from {step.right}")
