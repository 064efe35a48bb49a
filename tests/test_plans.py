import pytest

from assay.plans.generate import generate, groups_from, stored_or_generated
from assay.plans.model import Group, PlanError, control_from, ordered_groups, plan_from, step_from
from assay.plans.validate import errors_of, validate

N = {"type": "NORMALIZE", "dataset": "a", "output_alias": "n"}


def plan(*steps):
    return plan_from({"group_id": "g", "steps": list(steps), "generator": "test"})


def filter_(**more):
    return {"type": "FILTER", "input": "n", "conditions": ["x > 1"], "output_alias": "f"} | more


def test_round_trip_and_digest():
    p = plan(N, filter_(check_id="C"), {"type": "AGGREGATE", "input": "n", "metrics": [{"name": "m", "formula": "COUNT(*)", "filter": "x = 1"}]})
    again = plan_from(p.to_dict())
    assert again == p and again.digest == p.digest
    assert plan(N, filter_(check_id="D")).digest != p.digest
    assert plan_from(p.to_dict() | {"generator": "other"}).digest == p.digest


@pytest.mark.parametrize("raw, said", [
    ({"type": "SORT"}, "unknown type"),
    ({"type": "JOIN", "left": "a", "right": "b", "output_alias": "j"}, "needs 'left_key'"),
    ({"type": "JOIN", "left": "a", "right": "b", "left_key": "k", "right_key": "k", "output_alias": "j", "join_type": "cross"}, "join_type"),
    (filter_(conditions=[]), "needs 'conditions'"),
    ({"type": "AGGREGATE", "input": "n", "metrics": []}, "needs 'metrics'"),
    (filter_(colour="red"), "no field 'colour'"),
])
def test_wrong_steps(raw, said):
    with pytest.raises(PlanError, match=said):
        step_from(raw)


def test_both_spellings():
    assert step_from({"type": "UNIQUENESS", "input": "n", "key_fields": ["a"], "output_alias": "u"}).key_columns == ("a",)
    r = step_from({"type": "RECONCILIATION", "left": "a", "right": "b", "on": {"left_key": "x", "right_key": "y"}, "output_alias": "r"})
    assert (r.left_key, r.right_key) == ("x", "y")


@pytest.mark.parametrize("steps, said", [
    ([filter_()], "no alias of an earlier step"),
    ([N, N], "alias 'n' is there twice"),
    ([N | {"dataset": "zz"}], "dataset 'zz' is not declared"),
    ([N, filter_(check_id="Z")], "check 'Z' is not declared"),
    ([N, filter_(conditions=["1 = 1; DROP TABLE a"])], "not allowed"),
    ([N, filter_(conditions=["x > 1 -- all"])], "not allowed"),
    ([N, filter_(conditions=["x IN (SELECT 1)"])], "SELECT is not allowed"),
    ([N, filter_(conditions=["x > 1)  OR (1 = 1"])], "parentheses"),
    ([N | {"output_alias": "n n"}], "no identifier"),
    ([N, {"type": "COMPLETENESS", "input": "n", "check_field": "x", "filter": {"field": "y", "op": "~", "value": 1}, "output_alias": "c"}], "unknown comparison"),
    ([N, {"type": "THRESHOLD", "input": "n", "condition": "x > 1", "flag_field": "a-b", "output_alias": "t"}], "flag 'a-b'"),
])
def test_rules(steps, said):
    with pytest.raises(PlanError, match=said):
        validate(plan(*steps), ["a"], ["C"])


def test_words_in_strings_are_no_statements():
    assert errors_of(plan(N, filter_(conditions=["note = 'DROP; -- it''s text'"])), ["a"], []) == []


def test_controls_and_groups():
    c = control_from({"control_id": "X", "checks": [{"id": "C", "severity": "high", "type": "aggregate", "threshold": {"operator": ">=", "value": 1}}], "datasets": [{"id": "a", "path": "a.csv", "required_columns": ["k"]}]})
    assert c.severities() == {"C": "high"} and c.datasets[0].required_columns == ("k",)
    with pytest.raises(PlanError, match="severity"):
        control_from({"control_id": "X", "checks": [{"id": "C", "severity": "dire"}]})
    with pytest.raises(PlanError, match="twice"):
        control_from({"control_id": "X", "checks": [{"id": "C"}, {"id": "C"}]})
    assert [g.group_id for g in ordered_groups([Group("b", 2), Group("a", 1)])] == ["a", "b"]
    for groups in ([Group("a", 1), Group("a", 2)], [Group("a", 1), Group("b", 1)], [Group("a", 1, checks=("Z",))], [Group("a", 1, datasets=("z",))]):
        with pytest.raises(PlanError):
            ordered_groups(groups, c)


ANSWER = {"groups": [{"group_id": "g1", "checks": ["C"], "steps": [N, {"type": "COMPLETENESS", "input": "n", "check_field": "x", "output_alias": "c", "check_id": "C", "filter_field": "s", "filter_value": "T"}, {"type": "DATE_DIFF", "input": "n", "from_field": "x", "to_field": "y", "output_alias": "d"}]}]}


def test_generation_retries_and_stores(tmp_path):
    asked = []

    def provider(request):
        asked.append(request)
        return {"groups": [{"steps": [{"type": "WHAT"}]}]} if len(asked) == 1 else ANSWER

    groups = stored_or_generated(tmp_path, provider, "do it", {"a": {"x": "date"}}, wait=0) if False else generate(provider, "do it", {"a": {"x": "date"}}, wait=0)
    assert len(asked) == 2 and "unknown type" in asked[1]["errors"][0]
    step = groups[0].plan.steps[1]
    assert (step.filter.field, step.filter.op, step.filter.value) == ("s", "eq", "T") and groups[0].plan.steps[2].unit == "days"
    assert len(groups_from({"groups": [{"steps": [N, {"type": "WHAT"}]}]}, ["a"], strict=False)[0].plan.steps) == 1
    first = stored_or_generated(tmp_path, provider, "do it", {"a": {}})
    assert stored_or_generated(tmp_path, None, "", {}) == first and len(asked) == 3
    with pytest.raises(PlanError):
        stored_or_generated(tmp_path / "none", None, "", {})
    with pytest.raises(PlanError, match="after 2 attempts"):
        generate(lambda r: 1 / 0, "", {}, retries=2, wait=0)
