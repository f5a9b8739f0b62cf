"""A coverage report over the physical plan of a DataFrame.

What needs attention at scale is named with a reason: Python in the plan, cartesian products, single-partition exchanges,
scans that read every column, and joins without equality.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_NODE = re.compile(r"^[\s:+\-|]*(?:\*\s?\((\d+)\)\s*|\*\s*)?([A-Z][A-Za-z]+)")
#: Node names and why they are reported.
_REASONS = {
    "CartesianProduct": "every pair of rows is made",
    "BroadcastNestedLoopJoin": "each row meets every row of the broadcast side",
    "BatchEvalPython": "rows are pickled one by one to Python",
    "ArrowEvalPython": "batches travel to Python",
    "FlatMapGroupsInPandas": "whole groups travel to Python",
    "MapInPandas": "batches travel to Python",
    "MapInArrow": "batches travel to Python",
    "SortAggregate": "aggregation sorts first, as a buffer has no fixed length",
}


@dataclass
class Report:
    operators: Counter = field(default_factory=Counter)
    generated: int = 0
    shuffles: int = 0
    broadcasts: int = 0
    pushed: list[str] = field(default_factory=list)
    read: list[str] = field(default_factory=list)
    reasons: list[tuple[str, str]] = field(default_factory=list)

    @property
    def coverage(self) -> float:
        """The share of operators that run inside generated code; exchanges and scans don't count."""
        total = sum(n for k, n in self.operators.items() if not re.search("Exchange|Scan|AQE|AdaptiveSparkPlan|QueryStage", k))
        return self.generated / total if total else 1.0

    def __str__(self) -> str:
        lines = [f"{self.coverage:.0%} of operators in generated code, {self.shuffles} shuffles, {self.broadcasts} broadcasts"]
        lines += [f"  {n} x {k}" for k, n in sorted(self.operators.items())]
        lines += [f"  pushed: {p}" for p in self.pushed] + [f"  read: {r}" for r in self.read] + [f"  note: {k}: {why}" for k, why in self.reasons]
        return "\n".join(lines)


def explain(df: DataFrame, run: bool = False) -> Report:
    """The report of df's plan; with run, of the plan that adaptive execution settled on."""
    execution = df._jdf.queryExecution()
    if run:
        execution.toRdd().count()
    text = execution.executedPlan().toString()
    if "== Initial Plan ==" in text:
        text = text.split("== Initial Plan ==")[0]
    out = Report()
    for line in text.splitlines():
        if not (m := _NODE.match(line)):
            continue
        stage, name = m[1], m[2]
        if name in ("WholeStageCodegen", "InputAdapter"):
            continue
        out.operators[name] += 1
        out.generated += bool(stage)
        out.broadcasts += name == "BroadcastExchange"
        if name == "Exchange":
            out.shuffles += 1
            if "SinglePartition" in line:
                out.reasons.append((name, "all rows go to one task"))
        if name in _REASONS:
            out.reasons.append((name, _REASONS[name]))
        out.pushed += re.findall(r"PushedFilters: (\[[^\]]*\])", line)
        out.read += re.findall(r"ReadSchema: (struct<.*?>)(?:$|,)", line)
    return out


class PlanError(ValueError):
    """A plan holds what a strict reading does not allow."""


def strict(df: DataFrame, allowed: tuple[str, ...] = (), run: bool = False) -> Report:
    """The report of df's plan; raises PlanError with the reasons if it names any operator that isn't allowed."""
    found = explain(df, run)
    against = [f"{k}: {why}" for k, why in found.reasons if k not in allowed]
    if against:
        raise PlanError("; ".join(sorted(set(against))))
    return found


def summary(df: DataFrame) -> dict:
    """The figures of a report that a bench records."""
    found = explain(df)
    return {"shuffles": found.shuffles, "broadcasts": found.broadcasts, "generated": round(found.coverage, 2), "pushed": sum(p != "[]" for p in found.pushed), "notes": sorted({k for k, _ in found.reasons})}
