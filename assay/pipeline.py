"""A control from end to end: groups in order, each on its own datasets, then merged results, a report and the audit record.

Each group's violations are written before the next group runs, and all that is said about them is read from what was
written. So a group that fails, at whatever row, is recorded and costs the others nothing, and nothing is computed twice.
"""

from __future__ import annotations

import datetime as dt
import logging
import time
import uuid
from collections import Counter
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay import results
from assay.operators import Context
from assay.plans.model import Control, Group, ordered_groups
from assay.plans.planner import build
from assay.sources.reader import exists
from assay.sources.store import delete, save, scratch

log = logging.getLogger(__name__)


@dataclass
class ControlRun:
    control_id: str
    violations: DataFrame
    metrics: list[results.Metric]
    audit: list[results.GroupAudit]
    by_severity: dict[str, int] = field(default_factory=dict)
    #: The physical plans of each group's results, as text.
    plans: dict[str, str] = field(default_factory=dict)
    #: Where the violations are.
    table: str = ""

    @property
    def failed_groups(self) -> int:
        return sum(a.status != "success" for a in self.audit)

    @property
    def status(self) -> str:
        """error if all groups failed, or there are none."""
        return "error" if self.failed_groups == len(self.audit) else "success"

    @property
    def overall(self) -> str:
        return results.overall(self.by_severity, self.metrics, self.failed_groups)

    def report(self) -> dict:
        return {
            "control_id": self.control_id, "status": self.status, "overall": self.overall, "violations_by_severity": self.by_severity,
            "metrics": [asdict(m) for m in self.metrics], "groups": [{"group_id": a.group_id, "status": a.status, "error": a.error} for a in self.audit],
        }


def run_control(
    spark: SparkSession, control_id: str, groups: list[Group], datasets: Mapping[str, DataFrame], *, schemas: Mapping[str, Mapping[str, str]] | None = None,
    control: Control | None = None, as_of: dt.date | dt.datetime | None = None, recorded: Mapping[str, str] | None = None, only: str | None = None,
    collision_naming: str = "per_name", now: dt.datetime | None = None, table: str | None = None, stripped: frozenset[str] = frozenset(),
) -> ControlRun:
    """Run the groups' plans. ``recorded`` holds plan hashes by group: a plan that differs runs with a warning in its audit.

    ``table`` is where violations go, a Parquet table in a folder a group, in any store; what is there is replaced. Without it
    they go to the session's scratch folder. ``stripped`` names datasets whose texts have no white space around them.
    """
    now = now or dt.datetime.now()
    table = table or f"{scratch(spark)}/violations-{uuid.uuid4().hex}"
    delete(spark, table)
    audit, metrics, plans, by_severity = [], [], {}, Counter()
    facts: dict[str, dict] = {}
    for group in ordered_groups(groups, control):
        if only and group.group_id != only:
            continue
        began = time.monotonic()
        entry = results.GroupAudit(group.group_id, "success", group.plan.digest if group.plan else "", dt.datetime.now().isoformat(), 0)
        audit.append(entry)
        planned = None
        try:
            if group.plan is None:
                raise ValueError(f"group {group.group_id} has no plan")
            wanted = group.datasets or tuple(datasets)
            if missing := [d for d in wanted if d not in datasets]:
                raise FileNotFoundError(f"datasets are missing: {', '.join(missing)}")
            entry.manual_edit_warning = results.plan_hash_changed(group.plan, (recorded or {}).get(group.group_id))
            if entry.manual_edit_warning:
                log.warning("group %s: the plan isn't the one that was built", group.group_id)
            for d in wanted:
                if d not in facts:
                    facts[d] = {"dataset_id": d, "rows": datasets[d].count(), "data_hash": results.data_digest(datasets[d])}
            entry.datasets = [facts[d] for d in wanted]
            ctx = Context({d: datasets[d] for d in wanted}, schemas or {}, as_of, collision_naming, stripped)
            planned = build(group.plan, ctx, [c.check_id for c in control.checks] if control else None, keep_shared=True)
            plans[group.group_id] = planned.explain()
            own = results.metrics(planned, control_id, control, now)
            found = results.all_violations(planned, control_id, control.severities() if control else None, now, spark)
            found.write.mode("append").partitionBy("group_id").parquet(table)
            counts = results.violation_counts(_written(spark, table).where(F.col("group_id") == group.group_id))
            entry.checks = results.checks_of(counts, planned, own)
            for (_, severity), n in counts.items():
                by_severity[severity] += n
            metrics += own
        except Exception as e:  # noqa: BLE001  whatever a group's plan or data does, the other groups run
            entry.status, entry.error = "error", f"{type(e).__name__}: {e}"
            log.warning("group %s failed: %s", group.group_id, entry.error)
        finally:
            entry.duration_ms = int((time.monotonic() - began) * 1000)
            if planned:
                planned.release()
    return ControlRun(control_id, _written(spark, table), metrics, audit, dict(by_severity), plans, table)


def _written(spark: SparkSession, table: str) -> DataFrame:
    """All violations that groups have written so far."""
    if not exists(spark, table):
        return spark.createDataFrame([], results.VIOLATIONS)
    return spark.read.schema(results.VIOLATIONS).parquet(table).select(results.VIOLATIONS.names)


def write_run(run: ControlRun, folder: str | Path, table: str | None = None, shown: int = 100) -> None:
    """metrics.json, audit.json and validation_report.json in a folder, and for each group its results and physical plan.

    Violations stay where the run has written them if that is ``table`` (or violations.parquet in the folder); else they are
    copied there. A group's results hold the first ``shown`` of its violations and how many there are.
    """
    folder = Path(folder)
    table = table or str(folder / "violations.parquet")
    if run.table != table:
        run.violations.write.mode("overwrite").partitionBy("group_id").parquet(table)
    for a in run.audit:
        own = run.violations.where(F.col("group_id") == a.group_id).orderBy("check_id", "evidence").limit(shown).collect() if a.status == "success" else []
        count = sum(c["violations"] for c in a.checks if c["type"] != "aggregate")
        found = {"count": count, "table": table, "first": [r.asDict() for r in own]}
        save(folder / "groups" / a.group_id / "results.json", {"violations": found, "metrics": [asdict(m) for m in run.metrics if m.group_id == a.group_id], "checks": a.checks, "status": a.status, "error": a.error})
        save(folder / "groups" / a.group_id / "plan.txt", run.plans.get(a.group_id, ""))
    save(folder / "metrics.json", [asdict(m) for m in run.metrics])
    save(folder / "audit.json", {"control_id": run.control_id, "executed_at": dt.datetime.now().isoformat(), "total_violation_count": sum(run.by_severity.values()), "total_groups": len(run.audit), "groups": [asdict(a) for a in run.audit]})
    save(folder / "validation_report.json", run.report())
