"""The star scenario that the queries share: frames, rules, and the SQL of their facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import star_catalog
from ..plans.materialize import BASE, TYPE, RulePlanner
from ..plans.rules import Rule, RowFilter

NS = "urn:tpch:"
SCENARIO = "tpch"
Query = Callable[[SparkSession, str], DataFrame]


def register(registry: dict, name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        registry[name] = (f, sql)
        return f

    return put


def read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planner(spark: SparkSession, sf_dir: str, rules: list[Rule], frames: dict[str, DataFrame] | None = None, **more) -> RulePlanner:
    names = {t for r in rules for t in (r.source_table, r.target_table, r.subject_table, r.object_table) if t}
    return RulePlanner(SCENARIO, star_catalog(), read(spark, sf_dir, *names) | (frames or {}), rules, **more)


def cls(table_: str, name: str, **more) -> Rule:
    return Rule("class", table_, NS + name, **more)


def data(table_: str, column: str, name: str, **more) -> Rule:
    return Rule("data", table_, NS + name, source_column=column, **more)


def link(table_: str, columns: str, target: str, name: str, **more) -> Rule:
    return Rule("object", table_, NS + name, source_columns=tuple(columns.split()), target_table=target, **more)


def iri(table_: str, *columns: str) -> str:
    """SQL of an instance IRI of integer keys."""
    return f"'{BASE}{SCENARIO}/{table_}/' || " + " || '_' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


def fact(s: str, p: str, o: str, literal: bool, rest: str) -> str:
    return f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {str(literal).upper()} AS is_literal FROM {rest}"


#: Rules of the fact graph that most queries use, and its SQL.
STAR_RULES = [
    cls("customer", "Customer"), cls("nation", "Nation"), cls("region", "Region"), cls("supplier", "Supplier"), cls("orders", "Order"),
    data("customer", "c_name", "name"), data("customer", "c_mktsegment", "segment"), data("nation", "n_name", "name"), data("region", "r_name", "name"), data("supplier", "s_name", "name"), data("orders", "o_orderstatus", "status"),
    link("customer", "c_nationkey", "nation", "inNation"), link("supplier", "s_nationkey", "nation", "inNation"), link("nation", "n_regionkey", "region", "inRegion"), link("orders", "o_custkey", "customer", "placedBy"),
]
_KEYS = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "orders": "o_orderkey"}
_CLASSES = {"customer": "Customer", "nation": "Nation", "region": "Region", "supplier": "Supplier", "orders": "Order"}


def star_sql() -> str:
    parts = [fact(iri(t, _KEYS[t]), TYPE, f"'{NS}{_CLASSES[t]}'", False, t) for t in _KEYS]
    for t, c, n in (("customer", "c_name", "name"), ("customer", "c_mktsegment", "segment"), ("nation", "n_name", "name"), ("region", "r_name", "name"), ("supplier", "s_name", "name"), ("orders", "o_orderstatus", "status")):
        parts.append(fact(iri(t, _KEYS[t]), NS + n, c, True, f"{t} WHERE coalesce({c}, '') <> ''"))
    for t, c, r, n in (("customer", "c_nationkey", "nation", "inNation"), ("supplier", "s_nationkey", "nation", "inNation"), ("nation", "n_regionkey", "region", "inRegion"), ("orders", "o_custkey", "customer", "placedBy")):
        parts.append(fact(iri(t, _KEYS[t]), NS + n, iri(r, c), False, f"{t} WHERE {c} IN (SELECT {_KEYS[r]} FROM {r})"))
    return " UNION ALL ".join(parts)


STAR_SQL = star_sql()


def star_planner(spark: SparkSession, sf_dir: str) -> RulePlanner:
    return planner(spark, sf_dir, STAR_RULES)


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner(spark, sf_dir, STAR_RULES).graph()


def filtered(column: str, **how) -> RowFilter:
    return RowFilter(column, **how)
