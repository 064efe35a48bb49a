"""Row-wise plan steps over streaming DataFrames.

NORMALIZE, FILTER, DATE_DIFF, THRESHOLD and COMPLETENESS look at one row at a time and need no state. The other operators
need all rows; a plan that has them is refused for streams.
"""

from __future__ import annotations

from assay.operators import Context
from assay.plans.model import Plan, PlanError
from assay.plans.planner import Planned, build

ROW_WISE = frozenset({"NORMALIZE", "FILTER", "DATE_DIFF", "THRESHOLD", "COMPLETENESS"})


def build_stream(plan: Plan, ctx: Context) -> Planned:
    """The plan's DataFrames over streaming datasets; start each terminal's ``frame.writeStream`` as wanted."""
    if other := [f"step {s.id}: {s.kind} needs all rows and can't run on a stream" for s in plan.steps if s.kind not in ROW_WISE]:
        raise PlanError(other)
    return build(plan, ctx)
