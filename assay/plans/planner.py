"""From a plan to DataFrames: the steps are folded into named, lazy DataFrames, which Catalyst plans as one.

Datasets and aliases are two namespaces, so an alias may be called like its dataset. Aliases that several terminal steps
read through a join or an aggregation can be kept, so that they are computed once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import REGISTRY, Context

from .model import Plan, Step
from .validate import validate


@dataclass
class Terminal:
    """A step whose rows are results."""

    step: Step
    result_type: str
    frame: DataFrame


@dataclass
class Planned:
    plan: Plan
    env: dict[str, DataFrame]
    terminals: list[Terminal]
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    def explain(self) -> str:
        """The physical plans of all terminal steps, as an artifact for audits."""
        parts = []
        for t in self.terminals:
            mode = t.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            parts.append(f"-- {t.step.output_alias} ({t.result_type})\n{t.frame._jdf.queryExecution().explainString(mode)}")
        return "\n".join(parts)


def shared_aliases(plan: Plan) -> set[str]:
    """Joins and uniqueness counts that two or more terminal steps go back to."""
    by_alias = {s.output_alias: s for s in plan.steps}
    uses: Counter = Counter()
    for t in plan.steps:
        if t.is_terminal:
            seen, todo = set(), list(t.reads)
            while todo:
                a = todo.pop()
                if a not in seen and a in by_alias:
                    seen.add(a)
                    todo += by_alias[a].reads
            uses.update(seen)
    return {a for a, n in uses.items() if n > 1 and by_alias[a].kind in ("JOIN", "UNIQUENESS", "RECONCILIATION")}


def build(plan: Plan, ctx: Context, checks: list[str] | None = None, keep_shared: bool = False) -> Planned:
    """Validate the plan and make its DataFrames; nothing is computed.

    Each terminal frame starts with ``result_type``. ``keep_shared`` persists shared aliases (memory, then disk) until
    ``release``.
    """
    validate(plan, ctx.datasets, checks)
    env: dict[str, DataFrame] = {}
    terminals: list[Terminal] = []
    kept: list[DataFrame] = []
    shared = shared_aliases(plan) if keep_shared else set()
    for step in plan.steps:
        df = REGISTRY[step.kind](step, env, ctx)
        if step.output_alias in shared:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(df)
        env[step.output_alias] = df
        if step.is_terminal:
            out = df.drop("result_type").select(F.lit(step.result_type).alias("result_type"), "*")
            terminals.append(Terminal(step, step.result_type, out))
    return Planned(plan, env, terminals, kept)


def empty_result(spark: SparkSession) -> DataFrame:
    """The result of a plan without terminal steps: no rows of ``result_type``."""
    return spark.createDataFrame([], "result_type string")
