import datetime as dt
import json

import pytest

from assay.operators import Context
from assay.operators.sets import renamed_right
from assay.pipeline import run_control, write_run
from assay.plans.model import Group, PlanError, control_from, plan_from
from assay.plans.planner import build
from assay.results import checks_evaluated, data_digest, holds, metric_of, overall
from assay.streaming import build_stream

DAY = dt.date(2026, 5, 10)
PEOPLE = [("P1", "ACTIVE", None), ("P2", "TERMINATED", dt.date(2026, 4, 1)), ("P3", "TERMINATED", None), ("P4", "TERMINATED", dt.date(2026, 5, 1)), ("P5", "ACTIVE", dt.date(2026, 6, 1))]
ACCOUNTS = [("A1", "P1", "ACTIVE", None), ("A2", "P2", "ACTIVE", None), ("A3", "P4", "DISABLED", dt.date(2026, 5, 3)), ("A4", "P4", "DISABLED", dt.date(2026, 5, 1)), ("A5", None, "ACTIVE", None), ("A6", "P9", "ACTIVE", None)]


@pytest.fixture(scope="module")
def data(spark):
    return {
        "people": spark.createDataFrame(PEOPLE, "person_id string, status string, left_on date"),
        "accounts": spark.createDataFrame(ACCOUNTS, "account_id string, person_id string, status string, disabled_on date"),
    }


STEPS = [
    {"type": "NORMALIZE", "dataset": "people", "output_alias": "people"},
    {"type": "NORMALIZE", "dataset": "accounts", "output_alias": "accounts"},
    {"type": "JOIN", "left": "people", "right": "accounts", "left_key": "person_id", "right_key": "person_id", "output_alias": "j"},
    {"type": "FILTER", "input": "j", "conditions": ["status = 'TERMINATED'", "status_1 = 'ACTIVE' OR status_1 = 'OPEN'"], "output_alias": "open_accounts", "check_id": "C-1"},
    {"type": "DATE_DIFF", "input": "j", "from_field": "left_on", "to_field": "disabled_on", "output_alias": "d"},
    {"type": "THRESHOLD", "input": "d", "condition": "left_on_to_disabled_on_days <= 1", "flag_field": "in_time", "output_alias": "t"},
    {"type": "AGGREGATE", "input": "t", "check_id": "C-2", "metrics": [{"name": "rate", "formula": "ROUND(COUNT(*) FILTER (WHERE in_time)::DOUBLE / NULLIF(COUNT(*), 0), 4)"}, {"name": "n", "formula": "COUNT(*)"}]},
    {"type": "COMPLETENESS", "input": "people", "check_field": "left_on", "filter": {"field": "status", "op": "eq", "value": "TERMINATED"}, "output_alias": "c", "check_id": "C-3"},
    {"type": "RECONCILIATION", "left": "accounts", "right": "people", "left_key": "person_id", "right_key": "person_id", "output_alias": "r", "check_id": "C-4"},
    {"type": "UNIQUENESS", "input": "accounts", "key_columns": ["person_id"], "output_alias": "u", "check_id": "C-5"},
    {"type": "FILTER", "input": "people", "conditions": ["left_on > CURRENT_DATE"], "output_alias": "future", "check_id": "C-6"},
    {"type": "FILTER", "input": "people", "conditions": ["status = 'NONE'"], "output_alias": "none", "check_id": "C-7"},
]
CONTROL = {"control_id": "CTL", "checks": [{"check_id": f"C-{i}", "severity": "low" if i > 1 else "medium"} for i in (1, 3, 4, 5, 6, 7)] + [{"check_id": "C-2", "type": "aggregate", "severity": "medium", "threshold": {"operator": ">=", "value": 0.5}}]}


@pytest.fixture(scope="module")
def done(spark, data):
    groups = [Group("g2", 2, (), (), plan_from({"group_id": "g2", "steps": [STEPS[0] | {"dataset": "absent"}]})), Group("g1", 1, ("people", "accounts"), (), plan_from({"group_id": "g1", "steps": STEPS}))]
    return run_control(spark, "CTL", groups, data, control=control_from(CONTROL), as_of=DAY, recorded={"g1": "other"})


def test_violations(done):
    rows = done.violations.collect()
    got = {}
    for r in rows:
        e = json.loads(r.evidence)
        got.setdefault(r.check_id, []).append(e.get("account_id") or e["person_id"])
    assert {k: sorted(v) for k, v in got.items()} == {"C-1": ["A2"], "C-3": ["P3"], "C-4": ["A5", "A6"], "C-5": ["A3", "A4"], "C-6": ["P5"]}
    one = next(r for r in rows if r.check_id == "C-1")
    evidence = json.loads(one.evidence)
    assert evidence["disabled_on"] is None and evidence["person_id_1"] == "P2" and one.severity == "medium" and "check_id" not in evidence and one.reason == "Violation detected by C-1"


def test_metrics_and_report(done, tmp_path):
    (m,) = done.metrics
    assert (m.metric_name, m.metric_value, m.passed, m.supporting) == ("rate", 0.25, False, {"n": 4})
    assert done.status == "success" and done.overall == "FAIL" and done.failed_groups == 1
    ok, bad = sorted(done.audit, key=lambda a: a.group_id)
    assert ok.manual_edit_warning and bad.status == "error" and "absent" in bad.error
    assert {c["check_id"]: (c["violations"], c["type"]) for c in ok.checks} == {"C-1": (1, "row_level"), "C-2": (1, "aggregate"), "C-3": (1, "completeness"), "C-4": (2, "reconciliation"), "C-5": (2, "uniqueness"), "C-6": (1, "row_level"), "C-7": (0, "row_level")}
    write_run(done, tmp_path)
    assert json.loads((tmp_path / "validation_report.json").read_text())["overall"] == "FAIL"
    assert {p.name for p in tmp_path.iterdir()} == {"violations.parquet", "metrics.json", "audit.json", "validation_report.json", "groups"}
    assert "open_accounts" in (tmp_path / "groups/g1/plan.txt").read_text() and json.loads((tmp_path / "groups/g1/results.json").read_text())["metrics"][0]["metric_value"] == 0.25


def test_a_bad_row_fails_its_group_only(spark, tmp_path):
    """A division by zero in a column that no count needs: the group fails, its rows are left out, and the other's are written."""
    df = {"t": spark.createDataFrame([(1, None), (0, None), (5, "x")], "x int, s string")}
    n = {"type": "NORMALIZE", "dataset": "t", "output_alias": "n"}
    bad = [n, {"type": "THRESHOLD", "input": "n", "condition": "10 / x > 1", "flag_field": "flag", "output_alias": "f"}, {"type": "COMPLETENESS", "input": "f", "check_field": "s", "output_alias": "c", "check_id": "B"}]
    good = [n, {"type": "COMPLETENESS", "input": "n", "check_field": "s", "output_alias": "c", "check_id": "G"}]
    groups = [Group("bad", 1, ("t",), (), plan_from({"group_id": "bad", "steps": bad})), Group("good", 2, ("t",), (), plan_from({"group_id": "good", "steps": good}))]
    run = run_control(spark, "CTL", groups, df, table=str(tmp_path / "violations.parquet"))
    assert {a.group_id: a.status for a in run.audit} == {"bad": "error", "good": "success"} and "DIVIDE_BY_ZERO" in run.audit[0].error
    assert run.status == "success" and run.overall == "FAIL" and run.by_severity == {"medium": 2}
    write_run(run, tmp_path)
    assert {(r.group_id, r.check_id) for r in spark.read.parquet(str(tmp_path / "violations.parquet")).collect()} == {("good", "G")}
    audit = json.loads((tmp_path / "audit.json").read_text())
    assert [g["status"] for g in audit["groups"]] == ["error", "success"] and audit["total_violation_count"] == 2
    found = json.loads((tmp_path / "groups/good/results.json").read_text())["violations"]
    assert found["count"] == 2 and [v["check_id"] for v in found["first"]] == ["G", "G"]
    assert json.loads((tmp_path / "groups/bad/results.json").read_text())["violations"]["count"] == 0
    again = run_control(spark, "CTL", groups[1:], df, table=str(tmp_path / "violations.parquet"))
    assert again.violations.count() == 2


def test_no_groups_is_an_error(spark):
    run = run_control(spark, "CTL", [], {})
    assert run.status == "error" and run.violations.count() == 0


@pytest.mark.parametrize("row, want", [
    ({"check_id": "C", "n": 3, "x": 1.5}, ("n", 3.0, True, {"x": 1.5})),
    ({"_check_id": "C", "d": None, "flag": True, "n": 2}, ("flag", 1.0, True, {"d": None, "n": 2})),
    ({"n": 2, "passed": None}, ("n", 2.0, False, {})),
    ({"result_type": "aggregate", "s": "x"}, ("", None, True, {"s": "x"})),
])
def test_headline(row, want):
    m = metric_of(row, "CTL", "g")
    assert (m.metric_name, m.metric_value, m.passed, m.supporting) == want


def test_threshold_table():
    assert holds(1, ">=", 1) and holds(2, ">", 1) and holds(1, "<=", 1) and holds(0, "<", 1) and holds(1, "=", 1) and holds(1, "==", 1) and holds(2, "!=", 1) and holds(2, "<>", 1)
    assert not holds(1, "~", 1) and not holds(None, ">=", 1)
    assert overall({"low": 5}, []) == "PASS" and overall({"high": 1}, []) == "FAIL" and overall({}, [], 1) == "FAIL"


def test_digests_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: data_digest(spark.read.parquet(path))
    spark.range(10).selectExpr("id", "id % 2 as p").write.partitionBy("p").parquet(path)
    one = read()
    assert one == read() == data_digest(spark.read.parquet(path).where("id > 3")) and len(one) == 64
    spark.range(11).selectExpr("id", "id % 2 as p").write.mode("overwrite").partitionBy("p").parquet(path)
    assert read() != one and data_digest(spark.createDataFrame([(1,)], "x int")) == data_digest(spark.createDataFrame([(2,)], "x int"))


def test_collisions():
    assert renamed_right(["k", "s"], ["k", "s", "t"]) == ["k_1", "s_1", "t"]
    assert renamed_right(["k", "s"], ["k", "s", "t"], "running") == ["k_1", "s_2", "t"]
    assert renamed_right(["k", "k_1"], ["k", "K"]) == ["k_2", "K_3"] or len({n.lower() for n in renamed_right(["k", "k_1"], ["k", "K"])}) == 2


def test_outer_filter_names_the_check(spark, data):
    steps = [STEPS[0], {"type": "FILTER", "input": "people", "conditions": ["status = 'TERMINATED'"], "output_alias": "a", "check_id": "IN"}, {"type": "FILTER", "input": "a", "conditions": ["left_on IS NULL"], "output_alias": "b", "check_id": "OUT"}]
    planned = build(plan_from({"steps": steps}), Context(data, {}, DAY))
    assert [r.check_id for r in planned.env["b"].collect()] == ["OUT"] and planned.env["b"].columns.count("check_id") == 1
    assert "row_level" in planned.explain()
    assert checks_evaluated(planned.terminals[0].frame.limit(0), planned, [])[0]["violations"] == 0


def test_plan_errors_come_before_data(spark, data):
    with pytest.raises(PlanError):
        build(plan_from({"steps": [STEPS[0], {"type": "FILTER", "input": "people", "conditions": ["1=1; DROP TABLE x"], "output_alias": "f"}]}), Context(data))
    with pytest.raises(PlanError, match="filter"):
        build(plan_from({"steps": [STEPS[0], {"type": "AGGREGATE", "input": "people", "metrics": [{"name": "m", "formula": "ROUND(COUNT(*), 1)", "filter": "status = 'A'"}]}]}), Context(data))


def test_filters_reach_the_files(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "cast(id as double) as v", "'x' as s").write.parquet(str(tmp_path / "t"))
    steps = [{"type": "NORMALIZE", "dataset": "t", "output_alias": "n"}, {"type": "FILTER", "input": "n", "conditions": ["k > 90"], "output_alias": "f", "terminal": False}, {"type": "AGGREGATE", "input": "f", "metrics": [{"name": "m", "formula": "SUM(v)"}]}]
    planned = build(plan_from({"steps": steps}), Context({"t": spark.read.parquet(str(tmp_path / "t"))}, {"t": {"k": "integer", "v": "float", "s": "string"}}))
    text = planned.explain()
    assert "GreaterThan(k,90)" in text and "s:string" not in text.split("ReadSchema")[1].split("\n")[0]


def test_streams(spark, tmp_path):
    spark.range(10).selectExpr("id as k", "if(id % 2 = 0, null, 'x') as s").write.parquet(str(tmp_path / "t"))
    source = spark.readStream.schema("k long, s string").parquet(str(tmp_path / "t"))
    steps = [{"type": "NORMALIZE", "dataset": "t", "output_alias": "n"}, {"type": "COMPLETENESS", "input": "n", "check_field": "s", "output_alias": "c", "check_id": "C"}]
    (t,) = build_stream(plan_from({"steps": steps}), Context({"t": source})).terminals
    q = t.frame.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("found").collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(PlanError, match="needs all rows"):
        build_stream(plan_from({"steps": [steps[0], {"type": "UNIQUENESS", "input": "n", "key_columns": ["k"], "output_alias": "u"}]}), Context({"t": source}))


def files(tmp_path, plan):
    tmp_path.mkdir(exist_ok=True)
    (tmp_path / "people.csv").write_text('Person ID,Status\nP1,ACTIVE\nP2,\nP3,"two\nlines"\n')
    (tmp_path / "plans").mkdir(exist_ok=True)
    (tmp_path / "control.yaml").write_text("control_id: CTL\ndatasets: [{id: people, path: people.csv, required_columns: [person_id]}]\nchecks: [{id: C, severity: high}]\n")
    (tmp_path / "plans/groups.yaml").write_text("groups: [{group_id: g1, execution_order: 1, datasets: [people], checks: [C]}]\n")
    (tmp_path / "plans/g1.yaml").write_text(plan)
    return ["--control", str(tmp_path / "control.yaml"), "--out", str(tmp_path / "work")]


PLAN = "group_id: g1\nsteps:\n- {type: NORMALIZE, dataset: people, output_alias: n}\n- {type: FILTER, input: n, conditions: [\"status = 'ACTIVE'\"], output_alias: f, terminal: false}\n- {type: COMPLETENESS, input: n, check_field: status, output_alias: c, check_id: C}\n"


def test_command_line(spark, tmp_path, capsys, caplog):
    from assay.cli import main

    base = files(tmp_path, PLAN)
    assert main(["build", *base, "--dry-run"], spark) == 0 and not (tmp_path / "work").exists()
    assert main(["ingest", *base], spark) == 0 and main(["build", *base], spark) == 0
    assert main(["run", *base], spark) == 1
    assert json.loads(capsys.readouterr().out)["violations_by_severity"] == {"high": 1}
    (tmp_path / "plans/g1.yaml").write_text("group_id: g1\nsteps:\n- {type: NORMALIZE, dataset: other, output_alias: n}\n")
    assert main(["build", *base], spark) == 2
    assert main(["run", *base, "--group", "none"], spark) == 2


def test_edited_plans_are_told(spark, tmp_path, capsys):
    from assay.cli import main

    base = files(tmp_path, PLAN)
    warned = lambda: json.loads((tmp_path / "work/results/audit.json").read_text())["groups"][0]["manual_edit_warning"]
    assert main(["run", *base], spark) == 1 and not warned()
    (tmp_path / "plans/g1.yaml").write_text(PLAN.replace("'ACTIVE'", "'GONE'"))
    assert main(["execute", *base], spark) == 1 and warned()
    assert main(["run", *base], spark) == 1 and warned()
    assert main(["build", *base, "--force", "compile"], spark) == 0 and main(["execute", *base], spark) == 1 and not warned()


def test_text_filters_of_ingested_data_reach_the_files(spark, tmp_path, capsys):
    from assay.cli import main

    plan = PLAN.replace(", terminal: false", ", check_id: C")
    assert main(["run", *files(tmp_path, plan)], spark) == 1
    assert "EqualTo(status,ACTIVE)" in (tmp_path / "work/results/groups/g1/plan.txt").read_text()
    assert "EqualTo(status,ACTIVE)" in (tmp_path / "work/compiled/g1.txt").read_text()


def test_a_missing_file_is_its_groups_error(spark, tmp_path, capsys):
    from assay.cli import main

    base = files(tmp_path, PLAN)
    (tmp_path / "control.yaml").write_text("control_id: CTL\ndatasets: [{id: people, path: people.csv}, {id: gone, path: gone.csv}]\nchecks: [{id: C, severity: low}]\n")
    (tmp_path / "plans/groups.yaml").write_text("groups: [{group_id: g1, execution_order: 1, datasets: [people]}, {group_id: g2, execution_order: 2, datasets: [gone]}]\n")
    (tmp_path / "plans/g2.yaml").write_text("group_id: g2\nsteps:\n- {type: NORMALIZE, dataset: gone, output_alias: n}\n- {type: COMPLETENESS, input: n, check_field: x, output_alias: c, check_id: C}\n")
    assert main(["ingest", *base], spark) == 2 and main(["ingest", *base, "--dataset", "people"], spark) == 0
    assert main(["run", *base], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert [(g["group_id"], g["status"]) for g in report["groups"]] == [("g1", "success"), ("g2", "error")] and report["violations_by_severity"] == {"low": 1}


def answers(asked):
    """A provider: the plan of the tests, whatever is asked."""
    assert asked["schemas"]["people"]["status"] == "string" and asked["samples"]["people"]
    steps = [{"type": "NORMALIZE", "dataset": "people", "output_alias": "n"}, {"type": "COMPLETENESS", "input": "n", "check_field": "status", "output_alias": "c", "check_id": "C"}]
    return {"groups": [{"group_id": "g1", "datasets": ["people"], "steps": steps}]} if asked.get("wanted") != "steps" else {"steps": steps}


def answers_in_two(asked):
    return answers(asked)


answers_in_two.two_stages = True


@pytest.mark.parametrize("name", ["answers", "answers_in_two"])
def test_a_provider_writes_plans(spark, tmp_path, capsys, name):
    from assay.cli import main

    base = files(tmp_path, PLAN)
    (tmp_path / "plans/groups.yaml").unlink()
    assert main(["run", *base], spark) == 2 and main(["run", *base, "--provider", f"{__name__}:{name}", "--skip-llm"], spark) == 2
    assert main(["run", *base, "--provider", f"{__name__}:nobody"], spark) == 2
    assert main(["run", *base, "--provider", f"{__name__}:{name}"], spark) == 1
    assert json.loads(capsys.readouterr().out)["violations_by_severity"] == {"high": 1}
    assert (tmp_path / "plans/groups.yaml").exists() and main(["run", *base, "--skip-llm"], spark) == 1


def test_settings(spark, tmp_path, capsys, monkeypatch):
    from assay.cli import main
    from assay.settings import load_settings

    (tmp_path / "controls/one").mkdir(parents=True)
    files(tmp_path / "controls/one", PLAN)
    (tmp_path / "s.yaml").write_text(f"controls: {tmp_path}/controls\nout: {tmp_path}/out\nlog_json: true\nspark: {{spark.x: 1}}\n")
    got = load_settings(tmp_path / "s.yaml", {"ASSAY_RETRIES": "5", "ASSAY_NULL_TOKENS": ",none"})
    assert (got.log_json, got.retries, got.null_tokens, got.spark) == (True, 5, ("", "none"), {"spark.x": "1"})
    assert main(["run", "--settings", str(tmp_path / "s.yaml")], spark) == 1 and (tmp_path / "out/one/results/audit.json").exists()
    assert main(["run", "--settings", str(tmp_path / "s.yaml"), "--control", "one", "--out", str(tmp_path / "o2")], spark) == 1
    for env in ({"ASSAY_RETRIES": "many"}, {"ASSAY_LOG_JSON": "perhaps"}):
        with pytest.raises(PlanError):
            load_settings(None, env)
    (tmp_path / "bad.yaml").write_text("colour: red\n")
    assert main(["run", "--settings", str(tmp_path / "bad.yaml")], spark) == 2
    assert main(["run", "--control", "absent"], spark) == 2
