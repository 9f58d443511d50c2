"""Mapping patterns that a schema shows: classes, attributes, links and associations."""

from __future__ import annotations

from ..catalog import Catalog

# The names of patterns (WEAK_ENTITY is declared and never found).
TYPES = ("SCHEMA_ENTITY", "FK_OBJECT", "JOIN_TABLE_OBJECT", "ASSOCIATION_ENTITY", "SUBCLASS_PKFK", "WEAK_ENTITY", "LITERAL_ATTRIBUTE", "IDENTIFIER_AS_URI")


def patterns(catalog: Catalog) -> list[tuple[str, str, str, float]]:
    """(type, table, columns, score) in table order. A table of two keys and more columns is an association that is an entity as well."""
    out = []
    for t in catalog.tables.values():
        parent = catalog.parent_key(t.name)
        if t.role == "join_table":
            out.append(("JOIN_TABLE_OBJECT", t.name, ",".join(sorted(t.fk_columns)), 0.85))
        elif parent:
            out.append(("SUBCLASS_PKFK", t.name, ",".join(t.primary_key), 0.95))
        elif len(t.foreign_keys) > 1:
            out.append(("ASSOCIATION_ENTITY", t.name, ",".join(sorted(t.fk_columns)), 0.75))
        else:
            out.append(("SCHEMA_ENTITY", t.name, ",".join(t.key), 0.9))
        if t.primary_key and not parent and t.role != "join_table":
            out.append(("IDENTIFIER_AS_URI", t.name, ",".join(t.primary_key), 0.88))
        if t.role == "join_table":
            continue
        for fk in t.foreign_keys:
            if fk != parent:
                out.append(("FK_OBJECT", t.name, ",".join(fk.columns), 0.8))
        for c in t.names:
            if c not in t.primary_key and c not in t.fk_columns and not t.discriminator(c):
                out.append(("LITERAL_ATTRIBUTE", t.name, c, 0.7))
    return out
