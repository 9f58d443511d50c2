"""The registered queries by group, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from . import deciding, evaluating, graph, lake, mapping, profiling, reporting, retrieving, sampling, validating

GROUPS = (mapping, sampling, profiling, lake, retrieving, deciding, graph, evaluating, validating, reporting)


def queries() -> dict:
    return {name: f for g in GROUPS for name, (f, _) in g.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, (_, sql) in g.REGISTRY.items() if sql}
