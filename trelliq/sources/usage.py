"""What a query pair's texts use: tables and columns of the SQL, targets of the graph query; gold pairs from both."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..catalog import Catalog
from .ddl import bare
from .qpair import QueryPair

_ID = r'(?:"[^"]+"|[A-Za-z_][\w$-]*)'
_KEYWORDS = {"where", "on", "join", "left", "right", "inner", "outer", "full", "cross", "natural", "group", "order", "limit", "union", "using", "having", "as", "and"}
#: Prefixes whose names are vocabulary of the languages themselves.
STANDARD = {"rdf", "rdfs", "owl", "xsd"}


@dataclass
class SqlUse:
    tables: list[str] = field(default_factory=list)
    columns: list[tuple[str, str]] = field(default_factory=list)


def sql_use(sql: str, catalog: Catalog) -> SqlUse:
    """Tables after FROM and JOIN, columns qualified by a table or alias, and bare columns that only one of the tables has."""
    aliases: dict[str, str] = {}
    for m in re.finditer(rf"\b(?:FROM|JOIN)\s+((?:{_ID}\s*\.\s*)?{_ID})(?:\s+(?:AS\s+)?({_ID}))?", sql, re.I):
        table = bare(m[1])
        found = next((t for t in catalog.tables if t.lower() == table.lower()), None)
        if found:
            aliases[table] = aliases[found] = found
            if m[2] and m[2].lower() not in _KEYWORDS:
                aliases[bare(m[2])] = found
    tables = list(dict.fromkeys(aliases.values()))
    columns: list[tuple[str, str]] = []
    for m in re.finditer(rf"({_ID})\s*\.\s*({_ID})", sql):
        table, column = aliases.get(bare(m[1])), bare(m[2])
        if table and column in catalog.tables[table].names:
            columns.append((table, column))
    rest = re.sub(rf"{_ID}\s*\.\s*{_ID}|'[^']*'", " ", sql)
    for word in map(bare, re.findall(_ID, rest)):
        owners = [t for t in tables if word in catalog.tables[t].names]
        if len(owners) == 1 and word.lower() not in _KEYWORDS:
            columns.append((owners[0], word))
    return SqlUse(tables, list(dict.fromkeys(columns)))


def prefixes(query: str) -> dict[str, str]:
    return {m[1]: m[2] for m in re.finditer(r"PREFIX\s+([\w-]*)\s*:\s*<([^>]*)>", query, re.I)}


def graph_targets(query: str) -> list[str]:
    """Full and prefixed names of a graph query; names with a standard prefix are left out, standard full names aren't."""
    known = prefixes(query)
    body = re.sub(r"PREFIX\s+[\w-]*\s*:\s*<[^>]*>", " ", query, flags=re.I)
    out = re.findall(r"<([^<>\s]+)>", body)
    body = re.sub(r"<[^<>\s]+>|\"[^\"]*\"|\?\w+", " ", body)
    for m in re.finditer(r"(?<![\w:])([A-Za-z][\w-]*)?:([\w-]+)", body):
        prefix = m[1] or ""
        if prefix in known and prefix not in STANDARD:
            out.append(known[prefix] + m[2])
    return list(dict.fromkeys(out))


def gold_pairs(pair: QueryPair, catalog: Catalog, kinds: dict[str, str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """((source id, target), ...) of one query pair and ((target, issue), ...) of targets that no source of their kind stands for."""
    use = sql_use(pair.sql, catalog)
    gold, issues = [], []
    for target in graph_targets(pair.sparql):
        kind = kinds.get(target)
        if kind is None:
            issues.append((target, "target_not_in_ontology"))
            continue
        if kind == "class":
            found = [f"source-class:{t}" for t in use.tables if catalog.tables[t].role != "join_table"]
        elif kind == "data_property":
            found = [f"source-data:{t}.{c}" for t, c in use.columns if c not in catalog.tables[t].fk_columns]
        else:
            found = [f"source-object:{t}.{','.join(fk.columns)}" for t in use.tables for fk in catalog.tables[t].foreign_keys if any((t, c) in use.columns for c in fk.columns)]
        gold += [(s, target) for s in found]
        if not found:
            issues.append((target, "source_not_in_gold"))
    return gold, issues
