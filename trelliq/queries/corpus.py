"""A lake of schemas, matches, rules and runs made of the star tables: SQL that both engines read, so inputs grow with the tables.

An order is a table, its lines are the table's columns, and what a line's part and supplier are decides names, keys,
matches and rules. Nothing here is an answer: each query's SQL computes that from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def ask(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A SQL text over the star tables, which it names behind FROM and JOIN; no view is left in the session."""
    used = {n: table(spark, d, n) for n in TABLES if re.search(rf"(FROM|JOIN)\s+{n}\b", sql)}
    return spark.sql(re.sub(rf"(FROM|JOIN)(\s+)({'|'.join(TABLES)})\b", r"\1\2{\3}", sql.replace("{", "{{").replace("}", "}}")), **used)


def listed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as arrays of their comma-separated parts; empty and null texts are empty arrays."""
    return df.withColumns({c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "") for c in columns})


_T = "'t' || CAST({} AS STRING)"
COLUMNS = (
    "SELECT 't' || CAST(t AS STRING) AS table_name, position, CASE WHEN position = 1 AND x % 3 = 0 THEN 'id' WHEN position = 2 AND x % 5 = 0 THEN 'type' WHEN x % 7 = 0 THEN 'is_c' || CAST(position AS STRING) "
    "WHEN x % 4 = 0 THEN 'c' || CAST(position AS STRING) || '_id' ELSE 'c' || CAST(position AS STRING) END AS column_name, CASE WHEN x % 17 = 0 THEN 'boolean' ELSE 'text' END AS datatype, "
    "(position = 1 OR (t % 6 = 0 AND position <= 3)) AS is_pk, t, x, y FROM (SELECT l_orderkey AS t, l_linenumber AS position, min(l_partkey) AS x, min(l_suppkey) AS y FROM lineitem GROUP BY l_orderkey, l_linenumber) q"
)
KEYS = f"SELECT table_name AS child, CASE WHEN t % 10 = 0 AND position <= 2 THEN 1 ELSE position END AS key_id, column_name, {_T.format('(t - t % 8)')} AS parent, 'c' || CAST(position AS STRING) AS ref_column FROM ({COLUMNS}) c WHERE y % 3 = 0"
MATCHES = (
    f"SELECT 'source-data:' || table_name || '.' || column_name AS source_id, 'datatype_property' AS match_type, table_name, column_name, CASE WHEN x % 9 = 0 THEN NULL ELSE 'http://lake/p' || CAST(x % 40 AS STRING) END AS target FROM ({COLUMNS}) c WHERE position > 1 AND y % 2 = 0 "
    f"UNION ALL SELECT 'source-class:' || table_name, 'class', CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN x % 4 = 0 THEN NULL ELSE 'http://lake/Big_T' || CAST(t % 50 AS STRING) END FROM ({COLUMNS}) c WHERE position = 1"
)
RULES = (
    "SELECT kind || ':' || CAST(t * 10 + position AS STRING) AS rule_id, t * 10 + position AS number, kind, CASE WHEN y % 13 = 0 THEN 'ghost' ELSE table_name END AS source_table, CASE WHEN kind <> 'data' THEN '' WHEN y % 14 = 0 THEN 'nope' ELSE column_name END AS source_column, "
    "CASE WHEN kind = 'class' THEN 'http://lake/Big_T' || CAST(t % 50 AS STRING) WHEN kind = 'object' THEN 'http://lake/o' || CAST(x % 30 AS STRING) WHEN x % 10 = 0 THEN 'http://lake/x' ELSE 'http://lake/p' || CAST(x % 40 AS STRING) END AS target, "
    "CASE WHEN x % 6 = 0 THEN '' WHEN x % 6 = 1 THEN 'source-data:none' WHEN x % 6 = 2 OR kind = 'class' THEN 'source-class:' || table_name ELSE 'source-data:' || table_name || '.' || column_name END AS match_ids, "
    "CASE WHEN kind = 'class' AND x % 5 = 0 THEN 'c2' END AS filter_column, CASE WHEN kind = 'object' THEN column_name ELSE '' END AS source_columns, CASE WHEN kind <> 'object' THEN '' WHEN x % 11 = 0 THEN 'ghost' ELSE 't' || CAST((t - t % 8) AS STRING) END AS target_table, "
    "CASE WHEN kind <> 'object' THEN '' WHEN x % 5 = 0 THEN 'c9' ELSE 'c' || CAST(position AS STRING) END AS target_columns, CASE WHEN kind <> 'class' AND x % 8 = 0 THEN 't' || CAST((t - t % 8) AS STRING) ELSE '' END AS subject_table, CASE WHEN kind = 'object' AND x % 8 = 0 THEN CASE WHEN x % 24 = 0 THEN 'nope' ELSE column_name END ELSE '' END AS subject_columns, "
    "CASE WHEN kind = 'object' AND x % 8 = 0 THEN CASE WHEN x % 16 = 0 THEN 'ghost' ELSE table_name END ELSE '' END AS object_table, CASE WHEN kind = 'object' AND x % 8 = 0 THEN 'c1' ELSE '' END AS object_columns, t, x, y "
    f"FROM (SELECT *, CASE WHEN position = 1 THEN 'class' WHEN y % 2 = 0 THEN 'data' ELSE 'object' END AS kind FROM ({COLUMNS}) c) k"
)
#: Runs of three ways to map, one for each order.
RUNS = (
    "SELECT 's' || CAST(o_custkey AS STRING) AS scenario, CASE o_orderstatus WHEN 'F' THEN 'hybrid' WHEN 'O' THEN 'round2' ELSE 'default' END || CAST(o_orderkey % 2 AS STRING) AS arm, o_orderkey AS k, o_custkey % 97 + o_orderkey % 113 AS a, o_orderkey % 7 AS b, o_orderkey % 5 AS c, o_orderkey % 3 AS e, o_orderpriority AS priority, o_totalprice AS price FROM orders"
)


def columns(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, COLUMNS)


def keys(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, KEYS)


def matches(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, MATCHES)


def rules(spark: SparkSession, d: str) -> DataFrame:
    return listed(ask(spark, d, RULES), "match_ids", "source_columns", "target_columns", "subject_columns", "object_columns")


def duck(text: str, **parts: str) -> str:
    """DuckDB SQL with the lake's tables before it: c (columns), k (keys), m (matches), r (rules), w (columns with is_fk)."""
    known = {"c": COLUMNS, "k": KEYS, "m": MATCHES, "r": RULES, "runs": RUNS, "w": "SELECT c.*, f.child IS NOT NULL AS is_fk FROM c LEFT JOIN (SELECT DISTINCT child, column_name FROM k) f ON c.table_name = f.child AND c.column_name = f.column_name"}
    return f"WITH {', '.join(f'{n} AS ({q})' for n, q in (known | parts).items())} {text}"
