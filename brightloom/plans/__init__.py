"""Reading physical plans: which operators run, what is pushed down, and how much runs in generated code."""

from .report import PlanError, Report, explain, strict, summary

__all__ = ["PlanError", "Report", "explain", "strict", "summary"]
