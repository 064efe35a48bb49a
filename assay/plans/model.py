"""The plan language: nine kinds of steps, groups of checks, and control metadata, as frozen dataclasses.

``plan_from`` and ``control_from`` build them from plain dicts, as YAML or JSON files hold; wrong shapes raise PlanError.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any, ClassVar

SEVERITIES = ("critical", "high", "medium", "low")
CHECK_KINDS = ("row_level", "aggregate", "completeness", "reconciliation", "temporal")
JOIN_TYPES = ("inner", "left", "full")
#: Comparison operators of pre-filters, by name and by sign.
COMPARISONS = {"eq": "=", "neq": "<>", "gt": ">", "lt": "<", "gte": ">=", "lte": "<="}


class PlanError(ValueError):
    """A plan, control or expression that can't be accepted; ``errors`` lists all reasons."""

    def __init__(self, errors: list[str] | str):
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))


@dataclass(frozen=True)
class PreFilter:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Metric:
    name: str
    formula: str
    filter: str | None = None


@dataclass(frozen=True)
class Step:
    """What all steps have. ``kind`` names the operator; a terminal step's rows are results of ``result_type``."""

    id: str
    kind: ClassVar[str] = ""
    result_type: ClassVar[str | None] = None
    #: Other spellings of fields that plans may use.
    spellings: ClassVar[dict[str, str]] = {}

    @property
    def reads(self) -> tuple[str, ...]:
        """Aliases of the steps that this one reads."""
        return tuple(getattr(self, n) for n in ("input", "left", "right") if hasattr(self, n))

    @property
    def is_terminal(self) -> bool:
        return self.result_type is not None and getattr(self, "terminal", True)


@dataclass(frozen=True)
class Normalize(Step):
    dataset: str = ""
    output_alias: str = ""
    kind: ClassVar[str] = "NORMALIZE"


@dataclass(frozen=True)
class Join(Step):
    left: str = ""
    right: str = ""
    left_key: str = ""
    right_key: str = ""
    output_alias: str = ""
    join_type: str = "inner"
    kind: ClassVar[str] = "JOIN"


@dataclass(frozen=True)
class Filter(Step):
    input: str = ""
    conditions: tuple[str, ...] = ()
    output_alias: str = ""
    check_id: str | None = None
    terminal: bool = True
    kind: ClassVar[str] = "FILTER"
    result_type: ClassVar[str | None] = "row_level"


@dataclass(frozen=True)
class Aggregate(Step):
    input: str = ""
    metrics: tuple[Metric, ...] = ()
    output_alias: str = "agg_metrics"
    check_id: str | None = None
    group_by: tuple[str, ...] = ()
    kind: ClassVar[str] = "AGGREGATE"
    result_type: ClassVar[str | None] = "aggregate"


@dataclass(frozen=True)
class DateDiff(Step):
    input: str = ""
    from_field: str = ""
    to_field: str = ""
    output_alias: str = ""
    unit: str = "days"
    filter: PreFilter | None = None
    kind: ClassVar[str] = "DATE_DIFF"


@dataclass(frozen=True)
class Threshold(Step):
    input: str = ""
    condition: str = ""
    flag_field: str = ""
    output_alias: str = ""
    kind: ClassVar[str] = "THRESHOLD"


@dataclass(frozen=True)
class Completeness(Step):
    input: str = ""
    check_field: str = ""
    output_alias: str = ""
    filter: PreFilter | None = None
    check_id: str | None = None
    kind: ClassVar[str] = "COMPLETENESS"
    result_type: ClassVar[str | None] = "completeness"


@dataclass(frozen=True)
class Uniqueness(Step):
    input: str = ""
    key_columns: tuple[str, ...] = ()
    output_alias: str = ""
    check_id: str | None = None
    kind: ClassVar[str] = "UNIQUENESS"
    result_type: ClassVar[str | None] = "uniqueness"
    spellings: ClassVar[dict[str, str]] = {"key_fields": "key_columns"}


@dataclass(frozen=True)
class Reconciliation(Step):
    left: str = ""
    right: str = ""
    left_key: str = ""
    right_key: str = ""
    output_alias: str = ""
    check_id: str | None = None
    kind: ClassVar[str] = "RECONCILIATION"
    result_type: ClassVar[str | None] = "reconciliation"


STEPS: dict[str, type[Step]] = {c.kind: c for c in (Normalize, Join, Filter, Aggregate, DateDiff, Threshold, Completeness, Uniqueness, Reconciliation)}


@dataclass(frozen=True)
class Plan:
    group_id: str
    steps: tuple[Step, ...]
    generator: str = "manual"

    def to_dict(self) -> dict:
        return {"group_id": self.group_id, "generator": self.generator, "steps": [step_to_dict(s) for s in self.steps]}

    @property
    def digest(self) -> str:
        """SHA-256 of the steps in canonical JSON: the same for the same plan, whenever and by whatever it was made."""
        body = {"group_id": self.group_id, "steps": [step_to_dict(s) for s in self.steps]}
        return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def step_to_dict(step: Step) -> dict:
    """The dict that ``step_from`` reads; fields at their defaults are left out."""
    out: dict[str, Any] = {"type": step.kind}
    for f in fields(step):
        value = getattr(step, f.name)
        if f.name == "id" or value != f.default:
            out[f.name] = [asdict(m) if isinstance(m, Metric) else m for m in value] if isinstance(value, tuple) else asdict(value) if isinstance(value, PreFilter) else value
    return out


def step_from(raw: dict, position: int = 0) -> Step:
    """A step from its dict. Join keys may stand in a dict ``on``."""
    if not isinstance(raw, dict):
        raise PlanError(f"step {position}: not a mapping")
    where = f"step {raw.get('id', position)}"
    made = STEPS.get(str(raw.get("type", "")).upper())
    if made is None:
        raise PlanError(f"{where}: unknown type {raw.get('type')!r}")
    given = {made.spellings.get(k, k): v for k, v in raw.items() if k != "type" and v is not None}
    if isinstance(given.get("on"), dict):
        given |= given.pop("on")
    given.setdefault("id", f"s{position}")
    known = {f.name: f for f in fields(made)}
    errors = [f"{where}: {made.kind} has no field {k!r}" for k in given if k not in known]
    needed = [n for n, f in known.items() if n != "id" and (f.default == "" or f.default == () and n != "group_by")]
    errors += [f"{where}: {made.kind} needs {n!r}" for n in needed if not given.get(n)]
    try:
        if "metrics" in given:
            given["metrics"] = tuple(m if isinstance(m, Metric) else Metric(**m) for m in given["metrics"])
        if isinstance(given.get("filter"), dict):
            given["filter"] = PreFilter(**given["filter"])
    except TypeError as e:
        errors.append(f"{where}: {e}")
    for n in ("conditions", "key_columns", "group_by"):
        if n in given:
            given[n] = (given[n],) if isinstance(given[n], str) else tuple(given[n])
    if made is Join and given.get("join_type", "inner") not in JOIN_TYPES:
        errors.append(f"{where}: join_type is one of {', '.join(JOIN_TYPES)}")
    if errors:
        raise PlanError(errors)
    return made(**given)


def plan_from(raw: dict) -> Plan:
    """A plan from its dict; all steps' errors are reported together."""
    steps, errors = [], []
    for i, s in enumerate(raw.get("steps") or []):
        try:
            steps.append(s if isinstance(s, Step) else step_from(s, i))
        except PlanError as e:
            errors += e.errors
    if errors:
        raise PlanError(errors)
    return Plan(str(raw.get("group_id", "group")), tuple(steps), str(raw.get("generator", "manual")))


@dataclass(frozen=True)
class Check:
    check_id: str
    type: str = "row_level"
    severity: str = "medium"
    description: str = ""
    threshold: dict | None = None  # {operator, value}, for aggregates


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    path: str = ""
    sheet: str | None = None
    required_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Control:
    """Governance metadata of one control."""

    control_id: str
    name: str = ""
    description: str = ""
    datasets: tuple[Dataset, ...] = ()
    checks: tuple[Check, ...] = ()

    def check(self, check_id: str) -> Check | None:
        return next((c for c in self.checks if c.check_id == check_id), None)

    def severities(self) -> dict[str, str]:
        return {c.check_id: c.severity for c in self.checks}


def control_from(raw: dict) -> Control:
    """A control from its dict. Unknown severities, check types and repeated ids are errors."""
    errors: list[str] = []
    checks, datasets = [], []
    for c in raw.get("checks") or []:
        c = {"check_id" if k == "id" else k: v for k, v in c.items() if k in {"id", "check_id", "type", "severity", "description", "threshold"}}
        checks.append(Check(**c))
        if checks[-1].severity not in SEVERITIES:
            errors.append(f"check {checks[-1].check_id}: unknown severity {checks[-1].severity!r}")
        if checks[-1].type not in CHECK_KINDS:
            errors.append(f"check {checks[-1].check_id}: unknown type {checks[-1].type!r}")
    for d in raw.get("datasets") or []:
        d = {"dataset_id" if k == "id" else k: v for k, v in d.items() if k in {"id", "dataset_id", "path", "sheet", "required_columns"}}
        datasets.append(Dataset(**d | {"required_columns": tuple(d.get("required_columns") or ())}))
    for what, ids in (("check", [c.check_id for c in checks]), ("dataset", [d.dataset_id for d in datasets])):
        errors += [f"{what} {i} is there twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    meta = raw.get("control") or raw.get("meta") or raw
    if not meta.get("control_id") and not meta.get("id"):
        errors.append("control_id is missing")
    if errors:
        raise PlanError(errors)
    return Control(str(meta.get("control_id") or meta.get("id")), str(meta.get("name", "")), str(meta.get("description", "")), tuple(datasets), tuple(checks))


@dataclass(frozen=True)
class Group:
    """Checks that run together, on their own datasets."""

    group_id: str
    execution_order: int = 0
    datasets: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    plan: Plan | None = field(default=None, compare=False)


def ordered_groups(groups: list[Group], control: Control | None = None) -> list[Group]:
    """By execution order. Repeated ids or orders, and checks that the control doesn't have, or datasets if it lists any, are errors."""
    errors = []
    for what, values in (("group", [g.group_id for g in groups]), ("execution order", [g.execution_order for g in groups])):
        errors += [f"{what} {v} is there twice" for v in sorted({v for v in values if values.count(v) > 1})]
    if control is not None:
        checks, datasets = {c.check_id for c in control.checks}, {d.dataset_id for d in control.datasets}
        for g in groups:
            errors += [f"group {g.group_id}: unknown check {c}" for c in g.checks if c not in checks]
            errors += [f"group {g.group_id}: unknown dataset {d}" for d in g.datasets if datasets and d not in datasets]
    if errors:
        raise PlanError(errors)
    return sorted(groups, key=lambda g: g.execution_order)
