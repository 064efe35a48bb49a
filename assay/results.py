"""Results of plans: uniform violations, metrics with pass or fail, summaries and the audit record.

Violations stay distributed DataFrames. Metrics are one row (or one a group) and are judged on the driver.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import operator
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.base import TAGS, column
from assay.plans.model import Control, Plan
from assay.plans.planner import Planned, Terminal

VIOLATIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("control_id", "group_id", "check_id", "severity", "reason", "evidence")] + [T.StructField("detected_at", T.TimestampNTZType())])

_COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne}


def holds(value: float | None, sign: str, limit: float) -> bool:
    """Whether a metric keeps its threshold; a null one and an unknown sign don't."""
    compare = _COMPARE.get(sign)
    return bool(compare and value is not None and compare(value, limit))


@dataclass
class Metric:
    control_id: str
    group_id: str
    check_id: str
    metric_name: str
    metric_value: float | None
    passed: bool
    supporting: dict = field(default_factory=dict)
    evaluated_at: str = ""


def violations(terminal: Terminal, control_id: str, group_id: str, severities: Mapping[str, str] | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Rows of a terminal step as uniform records; what is no tag is evidence, as JSON that keeps nulls."""
    df = terminal.frame
    own = {c.lower() for c in df.columns}

    def tag(name: str):
        return F.nullif(F.col(name), F.lit("")) if name in own else F.lit(None).cast("string")

    check = F.coalesce(tag("check_id"), tag("_check_id"), F.lit("unknown"))
    pairs = [x for k, v in sorted((severities or {}).items()) for x in (F.lit(k), F.lit(v))]
    severity = F.coalesce(F.element_at(F.create_map(*pairs), check), F.lit("medium")) if pairs else F.lit("medium")
    evidence = [column(df, c) for c in df.columns if c.lower() not in TAGS]
    body = F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"}) if evidence else F.lit("{}")
    return df.select(
        F.lit(control_id).alias("control_id"), F.lit(group_id).alias("group_id"), check.alias("check_id"), severity.alias("severity"),
        F.coalesce(F.col("reason"), F.lit("Violation detected")).alias("reason") if "reason" in own else F.lit("Violation detected").alias("reason"),
        body.alias("evidence"), F.lit(now or dt.datetime.now()).cast("timestamp_ntz").alias("detected_at"),
    )


def all_violations(planned: Planned, control_id: str, severities: Mapping[str, str] | None = None, now: dt.datetime | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The violations of all terminal steps but aggregates."""
    parts = [violations(t, control_id, planned.plan.group_id, severities, now) for t in planned.terminals if t.result_type != "aggregate"]
    if not parts:
        return (spark or SparkSession.getActiveSession()).createDataFrame([], VIOLATIONS)
    return reduce(DataFrame.unionByName, parts)


def metric_of(row: Mapping, control_id: str, group_id: str, control: Control | None = None, now: dt.datetime | None = None) -> Metric:
    """A metric from its row: the first number is the headline, all other values support it.

    A column ``passed`` decides whether it passed (null: no); else the threshold of the control's check; else it passed. A
    boolean counts as a number, unless it is called ``passed``; decimals and dates don't.
    """
    check_id = row.get("check_id") or row.get("_check_id") or "unknown"
    name, value, supporting = "", None, {}
    for k, v in row.items():
        if k in TAGS or k == "passed":
            continue
        if not name and isinstance(v, (int, float)):
            name, value = k, float(v)
        else:
            supporting[k] = v
    check = control.check(check_id) if control else None
    limit = check.threshold if check else None
    passed = bool(row["passed"]) if "passed" in row else holds(value, str(limit.get("operator", ">=")), float(limit.get("value", 0))) if limit else True
    return Metric(control_id, group_id, check_id, name, value, passed, supporting, (now or dt.datetime.now()).isoformat())


def metrics(planned: Planned, control_id: str, control: Control | None = None, now: dt.datetime | None = None, most_rows: int = 10_000) -> list[Metric]:
    """The metrics of all aggregates. A grouped one gives one a group; more than ``most_rows`` groups raise an error, since
    metrics are a report (the terminal's frame has them all)."""
    out = []
    for t in planned.terminals:
        if t.result_type == "aggregate":
            rows = t.frame.limit(most_rows + 1).collect()
            if len(rows) > most_rows:
                raise ValueError(f"{t.step.output_alias}: more than {most_rows} metric rows")
            out += [metric_of(r.asDict(), control_id, planned.plan.group_id, control, now) for r in rows]
    return out


def violation_counts(found: DataFrame) -> dict[tuple[str, str], int]:
    """How many violations each check has of each severity: a row a check."""
    return {(r["check_id"], r["severity"]): r["n"] for r in found.groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n")).collect()}


def checks_evaluated(found: DataFrame, planned: Planned, own: list[Metric]) -> list[dict]:
    """For each check of the plan its type and how many violations it has, also if there is none."""
    counts = {(r["check_id"], ""): r["count"] for r in found.groupBy("check_id").count().collect()}  # a row a check
    return checks_of(counts, planned, own)


def checks_of(found: Mapping[tuple[str, str], int], planned: Planned, own: list[Metric]) -> list[dict]:
    """The same from the violations' counts by check and severity."""
    counts: dict[str, int] = {}
    for (check, _), n in found.items():
        counts[check] = counts.get(check, 0) + n
    out: dict[str, dict] = {}
    for t in planned.terminals:
        check = getattr(t.step, "check_id", None) or "unknown"
        if t.result_type == "aggregate":
            passed = all(m.passed for m in own if m.check_id == check)
            out.setdefault(check, {"check_id": check, "type": "aggregate", "violations": 0 if passed else 1, "passed": passed})
        elif check != "unknown" or counts.get(check):
            n = counts.get(check, 0)
            out.setdefault(check, {"check_id": check, "type": t.result_type, "violations": n, "passed": n == 0})
    return list(out.values())


def severity_summary(found: DataFrame) -> DataFrame:
    """How many violations of each severity."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n_violations"))


def overall(by_severity: Mapping[str, int], own: list[Metric], errors: int = 0) -> str:
    """FAIL for any critical or high violation, failed metric or group that ended in an error; else PASS."""
    bad = errors or by_severity.get("critical") or by_severity.get("high") or not all(m.passed for m in own)
    return "FAIL" if bad else "PASS"


def data_digest(df: DataFrame) -> str:
    """SHA-256 over the names of a table's files, their lengths and times: it changes when the data may have. Files are listed
    by Spark, as many at a time as there are; their contents aren't read."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves()
    roots = []
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            roots += [paths.apply(k).toString() for k in range(paths.size())]
    if not roots:
        return hashlib.sha256(b"").hexdigest()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(set(roots)))
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("time")).toArrow()
    return hashlib.sha256("\n".join(sorted(f"{f['name']}:{f['length']}:{f['time']}" for f in found.to_pylist())).encode()).hexdigest()


@dataclass
class GroupAudit:
    group_id: str
    status: str
    plan_hash: str
    started_at: str
    duration_ms: int
    datasets: list[dict] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    manual_edit_warning: bool = False
    error: str | None = None


def dumps(value) -> str:
    """JSON of records, dataclasses, dates and decimals."""

    def other(x):
        if isinstance(x, decimal.Decimal):
            return float(x)
        return x.asDict(recursive=True) if isinstance(x, T.Row) else asdict(x) if hasattr(x, "__dataclass_fields__") else str(x)

    return json.dumps(value, default=other, indent=2, ensure_ascii=False)


def plan_hash_changed(plan: Plan, recorded: str | None) -> bool:
    """Whether a plan isn't the one that was recorded, as after an edit by hand."""
    return recorded is not None and recorded != plan.digest
