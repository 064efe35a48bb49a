"""Plans from instructions: whoever writes them (a person, a service) is a callable; what it returns is checked like any plan.

A provider gets the instruction, the datasets' schemas and sample rows, and returns flat step specifications in groups.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping
from pathlib import Path

from .model import Group, Plan, PlanError, ordered_groups, step_from
from .validate import validate

Provider = Callable[[dict], dict]

#: Values that flat specifications may leave out.
DEFAULTS = {"JOIN": {"join_type": "inner"}, "DATE_DIFF": {"unit": "days"}, "THRESHOLD": {"flag_field": "flag"}}


def step_of(spec: Mapping, position: int = 0):
    """A step from a flat specification: pre-filters stand in filter_field, filter_op and filter_value, metrics in lists."""
    raw = {k: v for k, v in spec.items() if v not in (None, "", [], ()) and not k.startswith("filter_")}
    kind = str(raw.get("type", "")).upper()
    if spec.get("filter_field") and kind in ("DATE_DIFF", "COMPLETENESS"):
        raw["filter"] = {"field": spec["filter_field"], "op": spec.get("filter_op") or "eq", "value": spec.get("filter_value", "")}
    return step_from({**DEFAULTS.get(kind, {}), **raw}, position)


def request(instruction: str, schemas: Mapping[str, Mapping[str, str]], samples: Mapping[str, list[dict]], shown: int = 5) -> dict:
    """What a provider gets."""
    return {"instruction": instruction, "operators": ["NORMALIZE", "JOIN", "FILTER", "AGGREGATE", "DATE_DIFF", "THRESHOLD", "COMPLETENESS", "UNIQUENESS", "RECONCILIATION"], "schemas": {k: dict(v) for k, v in schemas.items()}, "samples": {k: v[:shown] for k, v in samples.items()}}


def groups_from(answer: Mapping, datasets: list[str], strict: bool = True) -> list[Group]:
    """The groups of an answer. A step that can't be read is an error, or, if not ``strict``, left out with a warning."""
    groups, errors = [], []
    for i, g in enumerate(answer.get("groups") or []):
        steps = []
        for k, spec in enumerate(g.get("steps") or []):
            try:
                steps.append(step_of(spec, k))
            except PlanError as e:
                if strict:
                    errors += e.errors
                else:
                    logging.getLogger(__name__).warning("group %s: a step is left out: %s", g.get("group_id", i), e)
        plan = Plan(str(g.get("group_id", f"group_{i + 1}")), tuple(steps), "provider")
        try:
            validate(plan, datasets, g.get("checks") or None)
        except PlanError as e:
            errors += e.errors
        groups.append(Group(plan.group_id, int(g.get("execution_order", i + 1)), tuple(g.get("datasets") or datasets), tuple(g.get("checks") or ()), plan))
    if errors:
        raise PlanError(errors)
    return groups


def generate(provider: Provider, instruction: str, schemas: Mapping[str, Mapping[str, str]], samples: Mapping[str, list[dict]] | None = None, retries: int = 3, wait: float = 1.0) -> list[Group]:
    """Groups that keep all rules; a provider that fails or answers wrongly is asked again, and told what was wrong."""
    asked = request(instruction, schemas, samples or {})
    last: Exception | None = None
    for attempt in range(retries):
        try:
            return groups_from(provider(asked), list(schemas))
        except Exception as e:  # noqa: BLE001  providers fail in their own ways
            last = e
            asked = asked | {"errors": getattr(e, "errors", [str(e)])}
            if attempt + 1 < retries:
                time.sleep(wait * 2**attempt)
    raise PlanError(f"no plan after {retries} attempts: {last}") from last


def generate_in_two(provider: Provider, instruction: str, schemas: Mapping[str, Mapping[str, str]], samples: Mapping[str, list[dict]] | None = None, retries: int = 3, wait: float = 1.0) -> list[Group]:
    """As ``generate``, with two kinds of requests: one for the groups (their ids, order, datasets and checks), then one for the
    steps of each group, which shows that group's datasets only. Each is asked again on its own."""
    asked = request(instruction, schemas, samples or {})

    def again(ask: dict, read: Callable[[dict], list[Group]]) -> list[Group]:
        last: Exception | None = None
        for attempt in range(retries):
            try:
                return read(provider(ask))
            except Exception as e:  # noqa: BLE001  providers fail in their own ways
                last = e
                ask = ask | {"errors": getattr(e, "errors", [str(e)])}
                if attempt + 1 < retries:
                    time.sleep(wait * 2**attempt)
        raise PlanError(f"no answer after {retries} attempts: {last}") from last

    def manifest(answer: Mapping) -> list[Group]:
        found = [Group(str(g["group_id"]), int(g.get("execution_order", i + 1)), tuple(g.get("datasets") or schemas), tuple(g.get("checks") or ())) for i, g in enumerate(answer.get("groups") or [])]
        errors = [f"group {g.group_id}: unknown dataset {d}" for g in found for d in g.datasets if d not in schemas]
        if errors or not found:
            raise PlanError(errors or ["there are no groups"])
        return ordered_groups(found)

    out = []
    for g in again({k: v for k, v in asked.items() if k != "operators"} | {"wanted": "groups"}, manifest):
        own = request(instruction, {d: schemas[d] for d in g.datasets}, {d: v for d, v in (samples or {}).items() if d in g.datasets})
        own |= {"wanted": "steps", "group_id": g.group_id, "checks": list(g.checks)}

        def steps(answer: Mapping, g: Group = g) -> list[Group]:
            return groups_from({"groups": [{"group_id": g.group_id, "execution_order": g.execution_order, "datasets": g.datasets, "checks": g.checks, "steps": answer.get("steps") or []}]}, list(g.datasets))

        out += again(own, steps)
    return out


def stored_or_generated(folder: str | Path, provider: Provider | None, instruction: str, schemas: Mapping[str, Mapping[str, str]], samples: Mapping[str, list[dict]] | None = None, force: bool = False, retries: int = 3) -> list[Group]:
    """The groups of the plan files in a folder, if there are any and they aren't to be replaced; else generated and stored.

    A provider with the attribute ``two_stages`` is asked for groups first and then for each group's steps.
    """
    from assay.sources.store import load, save

    folder = Path(folder)
    manifest = folder / "groups.yaml"
    if manifest.exists() and not force:
        from .model import plan_from

        return [Group(g["group_id"], int(g["execution_order"]), tuple(g.get("datasets") or ()), tuple(g.get("checks") or ()), plan_from(load(folder / f"{g['group_id']}.yaml"))) for g in load(manifest)["groups"]]
    if provider is None:
        raise PlanError(f"no plans in {folder}, and nobody to write them")
    make = generate_in_two if getattr(provider, "two_stages", False) else generate
    groups = make(provider, instruction, schemas, samples, retries)
    for g in groups:
        save(folder / f"{g.group_id}.yaml", g.plan.to_dict())
    save(manifest, {"groups": [{"group_id": g.group_id, "execution_order": g.execution_order, "datasets": list(g.datasets), "checks": list(g.checks), "plan_hash": g.plan.digest} for g in groups]})
    return groups
