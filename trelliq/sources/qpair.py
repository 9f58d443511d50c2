"""Query pairs: a SQL text and a graph query that should give the same answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

_KEYS = ("id", "name", "sql", "sparql", "categories", "disabled")
_START = re.compile(r"^\s*([A-Za-z][\w-]*)\s*=\s?(.*)$")


@dataclass(frozen=True)
class QueryPair:
    id: str
    name: str
    sql: str
    sparql: str
    categories: tuple[str, ...]
    disabled: bool


def clean(value: str) -> str:
    r"""Continuations (``\n\`` at a line's end, or a backslash) joined by single spaces."""
    return " ".join(re.sub(r"\\n\\?\s*(?:\n|$)|\\\s*\n", " ", value).split())


def parse_qpair(text: str, known: tuple[str, ...] = _KEYS) -> QueryPair:
    """Sections ``key = value`` over several lines; a line that begins another ``key =`` ends a section."""
    found: dict[str, list[str]] = {}
    current = None
    for line in text.splitlines():
        m = _START.match(line)
        open_ = current in found and found[current] and found[current][-1].rstrip().endswith("\\")
        if m and not open_ and (m[1].lower() in known or re.fullmatch(r"[a-z][\w-]*", m[1])):
            current = m[1].lower()
            found[current] = [m[2]]
        elif current is not None:
            found[current].append(line)
    value = {k: clean("\n".join(v)) for k, v in found.items()}
    listed = tuple(x.strip() for x in value.get("categories", "").split(",") if x.strip())
    return QueryPair(value.get("id", ""), value.get("name", ""), value.get("sql", ""), value.get("sparql", ""), listed, value.get("disabled", "").lower() in ("1", "true", "yes"))
