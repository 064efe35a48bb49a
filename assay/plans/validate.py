"""Rules that a plan must keep before anything is read. Broken ones raise; nothing runs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from assay.functions.translate import scan

from .model import COMPARISONS, Aggregate, Completeness, DateDiff, Filter, Join, Normalize, Plan, PlanError, PreFilter, Reconciliation, Threshold, Uniqueness

_IDENTIFIER = re.compile(r"[^\W\d]\w*\Z")


def errors_of(plan: Plan, datasets: Iterable[str] | None = None, checks: Iterable[str] | None = None) -> list[str]:
    """All broken rules. Datasets and check ids are only held against lists that are given."""
    errors: list[str] = []
    datasets = None if datasets is None else set(datasets)
    checks = None if checks is None else set(checks)
    known: set[str] = set()
    for step in plan.steps:
        where = f"step {step.id} ({step.kind})"

        def name(value: str, what: str, where: str = where) -> None:
            if not isinstance(value, str) or not _IDENTIFIER.match(value):
                errors.append(f"{where}: {what} {value!r} is no identifier")

        def expression(text: str, where: str = where) -> None:
            errors.extend(f"{where}: {e}" for e in scan(text))

        for alias in step.reads:
            if alias not in known:
                errors.append(f"{where}: {alias!r} is no alias of an earlier step")
        if isinstance(step, Normalize) and datasets is not None and step.dataset not in datasets:
            errors.append(f"{where}: dataset {step.dataset!r} is not declared")
        check = getattr(step, "check_id", None)
        if check is not None and checks is not None and check not in checks:
            errors.append(f"{where}: check {check!r} is not declared")
        if isinstance(step, (Join, Reconciliation)):
            name(step.left_key, "left key")
            name(step.right_key, "right key")
        if isinstance(step, Filter):
            for c in step.conditions:
                expression(c)
        if isinstance(step, Threshold):
            expression(step.condition)
            name(step.flag_field, "flag")
        if isinstance(step, Aggregate):
            for m in step.metrics:
                name(m.name, "metric")
                expression(m.formula)
                if m.filter:
                    expression(m.filter)
            names = [m.name for m in step.metrics] + list(step.group_by)
            errors += [f"{where}: {n!r} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
            for g in step.group_by:
                name(g, "group column")
        if isinstance(step, Uniqueness):
            for k in step.key_columns:
                name(k, "key")
        if isinstance(step, DateDiff):
            name(step.from_field, "field")
            name(step.to_field, "field")
        if isinstance(step, Completeness):
            name(step.check_field, "field")
        before = getattr(step, "filter", None)
        if isinstance(before, PreFilter):
            name(before.field, "field")
            if before.op not in COMPARISONS and before.op not in COMPARISONS.values() and str(before.op).upper() not in ("!=", "==", "LIKE", "ILIKE"):
                errors.append(f"{where}: unknown comparison {before.op!r}")
        alias = step.output_alias
        name(alias, "alias")
        if alias in known:
            errors.append(f"{where}: alias {alias!r} is there twice")
        known.add(alias)
    return errors


def validate(plan: Plan, datasets: Iterable[str] | None = None, checks: Iterable[str] | None = None) -> Plan:
    """The plan, if it keeps all rules; else PlanError with every broken one."""
    if found := errors_of(plan, datasets, checks):
        raise PlanError(found)
    return plan
