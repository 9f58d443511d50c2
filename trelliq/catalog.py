"""Relational metadata: tables, keys, roles, and where a table's identity comes from."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Column:
    name: str
    datatype: str = "text"
    nullable: bool = True


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def fk_columns(self) -> set[str]:
        return {c for fk in self.foreign_keys for c in fk.columns}

    @property
    def key(self) -> tuple[str, ...]:
        """The primary key, else the first column."""
        return self.primary_key or tuple(self.names[:1])

    @property
    def sampling_key(self) -> tuple[str, ...]:
        """The primary key, else the whole row."""
        return self.primary_key or tuple(self.names)

    @property
    def role(self) -> str:
        names, fk, pk = set(self.names), self.fk_columns, set(self.primary_key)
        if len(self.primary_key) > 1 and pk == names:
            return "join_table"
        if pk and pk <= fk:
            return "subtype_table"
        bridges = len(self.foreign_keys) > 1 and (names - fk) <= pk and len(names) <= len(fk) + 1
        return "join_table" if bridges else "entity_table"

    @property
    def join_like(self) -> bool:
        """Every column belongs to a foreign key."""
        return bool(self.foreign_keys) and set(self.names) <= self.fk_columns

    def generic_identifier(self, column: str) -> bool:
        low = column.lower()
        return low == "id" or (column in self.primary_key and low.endswith("_id")) or column in self.fk_columns

    def column_role(self, column: str) -> str:
        if column in self.primary_key:
            return "primary_key"
        if column in self.fk_columns:
            return "foreign_key"
        return "generic_identifier" if self.generic_identifier(column) else "attribute"

    def datatype(self, column: str) -> str:
        return next((c.datatype for c in self.columns if c.name == column), "")

    def discriminator(self, column: str) -> bool:
        """A column that names a row's class: is_..., type, or of a boolean type."""
        low = column.lower()
        return low.startswith("is_") or low == "type" or "bool" in self.datatype(column).lower()


@dataclass
class Catalog:
    tables: dict[str, TableMeta] = field(default_factory=dict)

    @classmethod
    def of(cls, tables: Iterable[TableMeta]) -> Catalog:
        return cls({t.name: t for t in tables})

    def parent_key(self, table: str) -> ForeignKey | None:
        """The first foreign key whose columns are the primary key, in order."""
        meta = self.tables.get(table)
        if not meta or not meta.primary_key:
            return None
        return next((fk for fk in meta.foreign_keys if fk.columns == meta.primary_key), None)

    def identity_chain(self, table: str) -> list[tuple[str, ForeignKey]]:
        """(table, key to its parent) from a table up to the one whose rows it shares its identity with. Cycles end it."""
        out, seen = [], set()
        while table in self.tables and table not in seen:
            seen.add(table)
            fk = self.parent_key(table)
            if fk is None:
                break
            out.append((table, fk))
            table = fk.ref_table
        return out

    def edges(self) -> list[tuple[str, str, str]]:
        """(kind, from, to) of the schema graph, columns as table.column."""
        out = []
        for t in self.tables.values():
            parent = self.parent_key(t.name)
            for c in t.names:
                out.append(("contains_column", t.name, f"{t.name}.{c}"))
            for c in t.primary_key:
                out.append(("primary_key", t.name, f"{t.name}.{c}"))
            for fk in t.foreign_keys:
                for c, r in zip(fk.columns, fk.ref_columns, strict=True):
                    out.append(("foreign_key", f"{t.name}.{c}", f"{fk.ref_table}.{r}"))
                out.append(("reverse_foreign_key", fk.ref_table, t.name))
                if fk == parent:
                    out.append(("primary_key_as_foreign_key", t.name, fk.ref_table))
        return out

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, i, c, c in t.primary_key, c in t.fk_columns, t.role, t.column_role(c), t.discriminator(c)) for t in self.tables.values() for i, c in enumerate(t.names)]
        return spark.createDataFrame(rows, "table_name string, position int, column_name string, is_pk boolean, is_fk boolean, table_role string, column_role string, discriminator boolean")

    def keys_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, ",".join(fk.columns), fk.ref_table, ",".join(fk.ref_columns)) for t in self.tables.values() for fk in t.foreign_keys]
        return spark.createDataFrame(rows, "child string, columns string, parent string, ref_columns string")


def _table(name: str, columns: str, pk: str = "", **fks: str) -> TableMeta:
    keys = tuple(ForeignKey((c,), r.split(".")[0], (r.split(".")[1],)) for c, r in fks.items())
    made = []
    for part in columns.split():
        n, _, kind = part.partition(":")
        made.append(Column(n, kind or "text"))
    return TableMeta(name, tuple(made), tuple(pk.split()), keys)


def star_catalog() -> Catalog:
    """The driver's star schema: keys hold at every scale."""
    return Catalog.of(
        [
            _table("region", "r_regionkey:int r_name", "r_regionkey"),
            _table("nation", "n_nationkey:int n_name n_regionkey:int", "n_nationkey", n_regionkey="region.r_regionkey"),
            _table("customer", "c_custkey:bigint c_name c_nationkey:int c_acctbal:double c_mktsegment", "c_custkey", c_nationkey="nation.n_nationkey"),
            _table("supplier", "s_suppkey:bigint s_name s_nationkey:int s_acctbal:double", "s_suppkey", s_nationkey="nation.n_nationkey"),
            _table("part", "p_partkey:bigint p_name p_brand p_type p_size:int p_retailprice:double", "p_partkey"),
            _table("orders", "o_orderkey:bigint o_custkey:bigint o_orderstatus o_totalprice:double o_orderdate:timestamp o_orderpriority", "o_orderkey", o_custkey="customer.c_custkey"),
            _table("lineitem", "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag l_linestatus l_shipdate:timestamp", "", l_orderkey="orders.o_orderkey", l_partkey="part.p_partkey", l_suppkey="supplier.s_suppkey"),
            _table("events", "event_id:bigint ts:timestamp user_id:bigint event_type value:double props", "event_id", user_id="customer.c_custkey"),
            _table("documents", "doc_id:bigint text lang source n_chars:bigint", "doc_id"),
            _table("labels", "doc_id:bigint quality:int toxic:int", "doc_id", doc_id="documents.doc_id"),
            _table("conversations", "conv_id:bigint turn:bigint role text", "conv_id turn"),
            _table("embeddings", "vec_id:bigint embedding label:int", "vec_id"),
            _table("pages", "page_id:bigint url html", "page_id"),
            _table("benchmark", "item_id:bigint text", "item_id"),
        ]
    )
