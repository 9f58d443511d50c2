"""Reads table definitions of a SQL dump into a catalog."""

from __future__ import annotations

import re

from ..catalog import Catalog, Column, ForeignKey, TableMeta

_NAME = r'(?:"[^"]+"|[\w$-]+)'
_QUALIFIED = rf"{_NAME}(?:\s*\.\s*{_NAME})?"
_LINES_SKIPPED = ("UNIQUE", "CHECK", "FOREIGN", "EXCLUDE")


def bare(name: str) -> str:
    """An identifier without schema and quotes."""
    return re.findall(_NAME, name)[-1].strip('"')


def _list(text: str) -> tuple[str, ...]:
    return tuple(bare(x) for x in re.findall(_NAME, text))


def _parts(body: str) -> list[str]:
    """Definitions between commas that stand in no parenthesis or quote."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if c in "\"'" and quote in ("", c):
            quote = "" if quote else c
        elif not quote:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(body[start:i])
                start = i + 1
    return [p.strip() for p in [*out, body[start:]] if p.strip()]


def parse_ddl(text: str) -> Catalog:
    """Tables with columns, nullability, and keys, inline or added by ALTER TABLE. Of tables of one name the last counts."""
    text = re.sub(r"--[^\n]*", "", text)
    tables: dict[str, dict] = {}
    for m in re.finditer(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QUALIFIED})\s*\((.*?)\)\s*(?:;|WITH\b)", text, re.I | re.S):
        columns, key = [], ()
        for part in _parts(m[2]):
            if pk := re.match(rf"(?:CONSTRAINT\s+{_NAME}\s+)?PRIMARY\s+KEY\s*\((.*)\)", part, re.I | re.S):
                key = _list(pk[1])
                continue
            head = re.sub(rf"^CONSTRAINT\s+{_NAME}\s+", "", part, flags=re.I)
            if head.upper().startswith(_LINES_SKIPPED):
                continue
            found = re.match(rf"({_NAME})\s*(.*)", part, re.S)
            name, rest = bare(found[1]), " ".join(found[2].split())
            kind = re.split(r"\s+(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY|UNIQUE|REFERENCES|CHECK|CONSTRAINT)\b", " " + rest, flags=re.I)[0].strip() or "text"
            inline = bool(re.search(r"\bPRIMARY\s+KEY\b", rest, re.I))
            key = (name,) if inline else key
            columns.append(Column(name, kind, not (inline or re.search(r"\bNOT\s+NULL\b", rest, re.I))))
        tables[bare(m[1])] = {"columns": tuple(columns), "key": key, "fks": []}
    alter = rf"ALTER\s+TABLE\s+(?:ONLY\s+)?({_QUALIFIED})\s+ADD\s+(?:CONSTRAINT\s+{_NAME}\s+)?"
    for m in re.finditer(alter + r"PRIMARY\s+KEY\s*\(([^)]*)\)", text, re.I):
        if (t := tables.get(bare(m[1]))) is not None:
            t["key"] = _list(m[2])
    for m in re.finditer(alter + rf"FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+({_QUALIFIED})\s*(?:\(([^)]*)\))?", text, re.I):
        if (t := tables.get(bare(m[1]))) is not None:
            parent = bare(m[3])
            ref = _list(m[4]) if m[4] else tables.get(parent, {}).get("key", ())
            t["fks"].append(ForeignKey(_list(m[2]), parent, ref))
    return Catalog.of(TableMeta(n, t["columns"], t["key"], tuple(t["fks"])) for n, t in tables.items())


def search_path(text: str) -> str | None:
    """The schema that a dump sets first, other than the system's; None if only the public one."""
    for m in re.finditer(r"(?:SET\s+search_path\s*=|set_config\('search_path',\s*')\s*([^;']*)", text, re.I):
        names = [bare(x) for x in m[1].split(",") if x.strip()]
        names = [n for n in names if n not in ("pg_catalog", "public")]
        if names:
            return names[0]
    return None
