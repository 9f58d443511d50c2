"""From matches to rules: classes first, then data and object rules whose direction the domains and ranges choose."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..catalog import Catalog, ForeignKey, TableMeta
from ..functions.text import CLASS_ALIASES, PERSONS, SEMANTIC_IDS, SEMANTIC_TARGETS, SPELT_OUT
from .rules import Rule, RowFilter


@dataclass(frozen=True)
class Match:
    """A source element and the target chosen for it (None: none fits)."""

    source_id: str
    target: str | None
    domain: tuple[str, ...] = ()
    range: tuple[str, ...] = ()
    row_filter: RowFilter | None = None
    confidence: float = 0.5


def word_set(text: str) -> frozenset[str]:
    """The driver's form of functions.text.word_set, for the few words of names."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"[_\-]+", " ", text or ""))
    out = set()
    for w in re.split(r"\W+", spaced.lower()):
        if not w:
            continue
        out |= {w, *SPELT_OUT.get(w, ())}
        out |= ({w[:-3] + "y"} if w.endswith("ies") else set()) | ({w[:-1]} if w.endswith("s") and len(w) > 3 else set())
    return frozenset(out | {b for a, b in PERSONS.items() if a in out})


def local_name(uri: str) -> str:
    return uri.rsplit("#", 1)[1] if "#" in uri else re.split(r"[/:]", uri.rstrip("/"))[-1]


def side_score(listed: tuple[str, ...], cls: str, unlisted: int = 1) -> int:
    """How well a class fits a domain or range: 2 for the same words, 1 for shared ones, ``unlisted`` without any listed."""
    if not listed:
        return unlisted
    mine = word_set(local_name(cls))
    return max(2 if (w := word_set(local_name(x))) == mine else 1 if w & mine else 0 for x in listed)


def best_score(match: Match, domains: list[str], ranges: list[str]) -> int:
    return max((side_score(match.domain, a) + side_score(match.range, b) for a in domains for b in ranges), default=0)


def _split(source_id: str) -> tuple[str, str, list[str]]:
    kind, _, tail = source_id.partition(":")
    table, _, columns = tail.partition(".")
    return kind, table, columns.split(",") if columns else []


# Names of classes that rows with a type value are of, by the table's own class; other names of classes; and
# columns of join tables by the table that they refer to without a key.
TYPE_CLASSES = {"Paper": (("1", "PaperFullVersion"), ("2", "PaperAbstract")), "Document": (("1", "Paper"), ("2", "Abstract"))}
COMMITTEE = ("ProgramCommittee", "Program_committee")
FEES = ("Registration_fee", "Fee")
REFERRED = {"aid": "authors", "author": "authors", "conference_member": "conf_members", "paper": "papers", "pid": "papers", "program_committee_member": "pc_members", "reviewer": "reviewers", "rid": "reviewers"}


def namespace(uri: str) -> str:
    return uri.rsplit("#", 1)[0] + "#" if "#" in uri else uri.rstrip("/").rsplit("/", 1)[0] + "/"


def discriminator_classes(column: str) -> list[str]:
    """The driver's form of functions.text.discriminator_classes."""
    low = column.lower()
    title = "_".join(w[:1].upper() + w[1:] for w in column.replace("-", "_").split("_") if w)
    name = column[3:] if low.startswith("is_") else CLASS_ALIASES.get(low, title)
    flat = name.lower().replace("-", "_")
    more = ["Author_of_paper", "Author"] * flat.startswith("author_of_paper") + ["Student"] * (flat.endswith("_student") or flat == "student")
    return list(dict.fromkeys([name, *more]))


def semantic_identifier(table: str, column: str, target: str) -> bool:
    """The driver's form of functions.text.semantic_identifier."""
    low, words = column.lower(), word_set(target)
    joined = "".join(words)
    paper = "paper" in word_set(table) and "paper" in joined and "id" in joined
    return low != "id" and (paper or low in SEMANTIC_IDS and bool(words & set(SEMANTIC_TARGETS)))


def inferred_classes(meta: TableMeta, cls: str) -> list[Rule]:
    """Class rules that a table of class ``cls`` gives besides: by its boolean columns, its type column, and other names of its class."""
    ns, name = namespace(cls), local_name(cls)
    rule = lambda target, f=None: Rule("class", meta.name, ns + target, id_columns=meta.key, row_filter=f)
    out = [rule(n, RowFilter(c, truthy=True)) for c in meta.names if c.lower().startswith("is_") or "bool" in meta.datatype(c).lower() for n in discriminator_classes(c)]
    typed = next((c for c in meta.names if c.lower() == "type"), None)
    if typed:
        out += [rule(n, RowFilter(typed, equals=value)) for value, n in TYPE_CLASSES.get(name, ())]
    words = word_set(meta.name) | word_set(name)
    if "fee" in words:
        out += [rule(n) for n in FEES if n == "Fee" or "registration" in words]
    if name == COMMITTEE[0]:
        out.append(rule(COMMITTEE[1]))
    return out


def referred(column: str, catalog: Catalog) -> str | None:
    """The table that a column without a key refers to by its name, if any does."""
    if REFERRED.get(column) in catalog.tables:
        return REFERRED[column]
    return next((t for t in (column, column + "s", column.replace("_id", "")) if t in catalog.tables), None)


def compile_rules(matches: list[Match], catalog: Catalog) -> list[Rule]:
    """Rules of the accepted matches: classes, what they imply, then data and object rules.

    Join tables give no class. Discriminators are no literals, and identifiers only where both column and target name
    one. Equal class rules are one.
    """
    chosen = [m for m in matches if m.target and re.match("https?://|urn:", m.target)]
    rules: list[Rule] = []
    own: dict[str, str] = {}

    def add(rule: Rule) -> None:
        if not any((r.source_table, r.target, r.row_filter) == (rule.source_table, rule.target, rule.row_filter) for r in rules):
            rules.append(rule)

    for m in chosen:
        kind, table, _ = _split(m.source_id)
        meta = catalog.tables.get(table)
        if kind == "source-class" and meta and meta.role != "join_table" and word_set(table) & word_set(m.target):
            own[table] = m.target
            add(Rule("class", table, m.target, id_columns=meta.key, match_ids=(m.source_id,)))
        if kind == "source-discriminator" and meta and m.row_filter:
            add(Rule("class", table, m.target, id_columns=meta.key, row_filter=m.row_filter, match_ids=(m.source_id,)))
    for table, cls in own.items():
        for rule in inferred_classes(catalog.tables[table], cls):
            add(rule)
    classes: dict[str, list[str]] = {}
    for table in dict.fromkeys([*own, *(r.source_table for r in rules)]):
        classes[table] = list(dict.fromkeys(([own[table]] if table in own else []) + [r.target for r in rules if r.source_table == table]))
    for m in chosen:
        kind, table, columns = _split(m.source_id)
        meta = catalog.tables.get(table)
        if not meta or not columns or any(c not in meta.names for c in columns):
            continue
        if kind == "source-data":
            rules += _data(m, meta, columns[0], classes, own)
        elif kind == "source-object":
            rules += _object(m, meta, tuple(columns), catalog, classes, own)
    return rules


def _data(m: Match, meta: TableMeta, column: str, classes: dict[str, list[str]], own: dict[str, str]) -> list[Rule]:
    rule = Rule("data", meta.name, m.target, source_column=column, match_ids=(m.source_id,))
    if meta.discriminator(column) or meta.generic_identifier(column) and not semantic_identifier(meta.name, column, m.target):
        return []
    if any(side_score(m.domain, c) > 0 for c in classes.get(meta.name, [])):
        return [rule]
    # an attribute table: the first referenced table whose class the domain takes
    for fk in meta.foreign_keys:
        if column not in fk.columns and fk.ref_table in own and side_score(m.domain, own[fk.ref_table]) > 0:
            return [replace(rule, subject_table=fk.ref_table, subject_columns=fk.columns, subject_target_columns=fk.ref_columns)]
    return []


def _ends(meta: TableMeta, fk: ForeignKey, catalog: Catalog) -> list[ForeignKey]:
    """The other ends of a join table's rows: its other keys, then columns that refer to a table by their name."""
    out = [f for f in meta.foreign_keys if f.columns != fk.columns]
    taken = {c for f in [fk, *out] for c in f.columns}
    for c in meta.names:
        table = referred(c, catalog) if c not in taken else None
        if table:
            out.append(ForeignKey((c,), table, catalog.tables[table].key))
    return out


def _object(m: Match, meta: TableMeta, columns: tuple[str, ...], catalog: Catalog, classes: dict[str, list[str]], own: dict[str, str]) -> list[Rule]:
    base = Rule("object", meta.name, m.target, match_ids=(m.source_id,))
    out = []
    for fk in (f for f in meta.foreign_keys if f.columns == columns):
        here, there = classes.get(meta.name, []), classes.get(fk.ref_table, [])
        if meta.role == "join_table":
            for other in _ends(meta, fk, catalog) if there else []:
                far = classes.get(other.ref_table, [])
                forth, back = best_score(m, there, far), best_score(m, far, there)
                if far and max(forth, back) > 0:
                    a, b = (other, fk) if back > forth else (fk, other)
                    out.append(replace(base, subject_table=a.ref_table, subject_columns=a.columns, subject_target_columns=a.ref_columns, object_table=b.ref_table, object_columns=b.columns, object_target_columns=b.ref_columns))
        elif fk.ref_table in own and here and best_score(m, here, there) > 0:
            out.append(replace(base, source_columns=fk.columns, target_table=fk.ref_table, target_columns=fk.ref_columns))
        elif fk.ref_table in own and here and best_score(m, there, here) > 0:
            out.append(replace(base, subject_table=fk.ref_table, subject_columns=fk.columns, subject_target_columns=fk.ref_columns, object_table=meta.name, object_columns=meta.key, object_target_columns=meta.key))
    return out
