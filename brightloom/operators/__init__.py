from . import aggregates, generators, joins, relational, setops, tpch, udfs, windows  # noqa: F401
