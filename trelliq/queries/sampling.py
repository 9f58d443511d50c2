"""samp_*: stable, key-consistent samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalog, Column, ForeignKey, TableMeta, star_catalog
from ..functions import text
from ..operators import sampling as ops
from .base import read, register, table

REGISTRY: dict = {}
SEED = "sample-v1"


def keep_sql(name: str, key: str, fraction: float) -> str:
    return f"(CAST('0x' || substr(sha256('{SEED}|{name}|' || {key}), 1, 12) AS BIGINT) / 281474976710655.0 < {fraction})"


_CLOSED = f"""WITH o AS (SELECT * FROM orders WHERE {keep_sql('orders', 'o_orderkey', 0.1)}),
c AS (SELECT * FROM customer WHERE {keep_sql('customer', 'c_custkey', 0.1)} OR c_custkey IN (SELECT o_custkey FROM o)),
n AS (SELECT * FROM nation WHERE {keep_sql('nation', 'n_nationkey', 0.1)} OR n_nationkey IN (SELECT c_nationkey FROM c)),
r AS (SELECT * FROM region WHERE {keep_sql('region', 'r_regionkey', 0.1)} OR r_regionkey IN (SELECT n_regionkey FROM n))"""
_TABLES = (("orders", "o", "o_orderkey"), ("customer", "c", "c_custkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey"))


@register(REGISTRY, "samp_stable_keep", f"SELECT o_orderkey FROM orders WHERE {keep_sql('orders', 'o_orderkey', 0.1)}")
def _(spark, d):
    return table(spark, d, "orders").filter(text.stable_keep(SEED, "orders", [F.col("o_orderkey")], 0.1)).select("o_orderkey")


@register(REGISTRY, "samp_fk_closure", _CLOSED + " " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST({k} AS BIGINT) AS key FROM {a}" for t, a, k in _TABLES))
def _(spark, d):
    kept = ops.closed_sample(star_catalog(), read(spark, d, *[t for t, _, _ in _TABLES]), 0.1, SEED)
    parts = [kept[t].select(F.lit(t).alias("table_name"), F.col(k).cast("long").alias("key")) for t, _, k in _TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register(REGISTRY, "samp_summary", _CLOSED + " " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS full_rows, (SELECT count(*) FROM {a}) AS dev_rows" for t, a, _ in _TABLES))
def _(spark, d):
    frames = read(spark, d, *[t for t, _, _ in _TABLES])
    return ops.sample_summary(frames, ops.closed_sample(star_catalog(), frames, 0.1, SEED))


def _linked() -> Catalog:
    col = lambda *n: tuple(map(Column, n))
    star = star_catalog().tables
    bought = TableMeta("bought", col("l_orderkey", "l_partkey"), (), (ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey(("l_partkey",), "part", ("p_partkey",))))
    return Catalog.of([TableMeta("orders", star["orders"].columns, ("o_orderkey",)), star["part"], bought])


@register(
    REGISTRY,
    "samp_join_like",
    f"SELECT l_orderkey, l_partkey FROM lineitem WHERE {keep_sql('bought', "l_orderkey || '|' || l_partkey", 0.4)} AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE {keep_sql('orders', 'o_orderkey', 0.4)}) AND l_partkey IN (SELECT p_partkey FROM part WHERE {keep_sql('part', 'p_partkey', 0.4)})",
)
def _(spark, d):
    frames = read(spark, d, "orders", "part") | {"bought": table(spark, d, "lineitem").select("l_orderkey", "l_partkey")}
    return ops.closed_sample(_linked(), frames, 0.4, SEED)["bought"].select("l_orderkey", "l_partkey")
