"""Mapping rules: class, data and object rules over a catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RowFilter:
    column: str
    truthy: bool = False
    equals: str | None = None


@dataclass(frozen=True)
class Rule:
    """One declarative rule; which fields count depends on ``kind``.

    class: source_table, target, id_columns, row_filter. data: source_table, source_column, target and, for a subject
    that the row refers to, subject_table, subject_columns, subject_target_columns. object: source_columns,
    target_table, target_columns; or subject and object side through an association (subject_*, object_*).
    """

    kind: str
    source_table: str
    target: str
    source_column: str = ""
    id_columns: tuple[str, ...] = ()
    row_filter: RowFilter | None = None
    source_columns: tuple[str, ...] = ()
    target_table: str = ""
    target_columns: tuple[str, ...] = ()
    subject_table: str = ""
    subject_columns: tuple[str, ...] = ()
    subject_target_columns: tuple[str, ...] = ()
    object_table: str = ""
    object_columns: tuple[str, ...] = ()
    object_target_columns: tuple[str, ...] = ()
    match_ids: tuple[str, ...] = ()


RULES_SCHEMA = "rule_id string, kind string, source_table string, target string, source_column string, source_columns string, target_table string, target_columns string, subject_table string, object_table string, filter_column string, filter_truthy boolean, filter_equals string, match_ids array<string>"


def numbered(rules: list[Rule]) -> list[tuple[str, Rule]]:
    """Rule ids are the kind and the number within it."""
    seen: dict[str, int] = {}
    out = []
    for r in rules:
        out.append((f"{r.kind}:{seen.get(r.kind, 0)}", r))
        seen[r.kind] = seen.get(r.kind, 0) + 1
    return out


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = []
    for i, r in numbered(rules):
        f = r.row_filter
        rows.append((i, r.kind, r.source_table, r.target, r.source_column, ",".join(r.source_columns), r.target_table, ",".join(r.target_columns), r.subject_table, r.object_table, f.column if f else None, f.truthy if f else None, f.equals if f else None, list(r.match_ids)))
    return spark.createDataFrame(rows, RULES_SCHEMA)
