"""Prints which queries cover each entry of the inventory: python -m brightloom.coverage > COVERAGE.md"""

from __future__ import annotations

from . import catalog


def markdown() -> str:
    rows = sorted(catalog.coverage().items())
    lines = ["# Inventory entries and the queries that cover them", "", "`fn.x` is the function x; each query has comparison SQL and is tested against it.", "", "| entry | queries |", "| --- | --- |"]
    lines += [f"| `{k.replace('|', chr(92) + '|')}` | {', '.join(v)} |" for k, v in rows]
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    print(markdown(), end="")
