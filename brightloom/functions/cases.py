"""One query for several expressions over a table: alias, Spark's wording, and the comparison's where it differs."""

from __future__ import annotations

from ..registry import sql


def case(name: str, table: str, key: str, *rows: tuple, where: str = "", covers: str = "") -> None:
    spark = ", ".join(f"{r[1]} as {r[0]}" for r in rows)
    other = ", ".join(f"{r[2] if len(r) > 2 else r[1]} as {r[0]}" for r in rows)
    tail = f" from {table}" + (f" where {where}" if where else "") if table else ""
    lead = f"{key}, " if key else ""
    sql(name, f"select {lead}{spark}{tail}", f"select {lead}{other}{tail}", covers)


def fn(names: str) -> str:
    return " ".join(f"fn.{n}" for n in names.split())
