"""A graph-pattern query language over (s, p, o, is_literal), compiled to DataFrame joins.

Understood: PREFIX, SELECT [DISTINCT] of variables or * or aggregates (COUNT, COUNT DISTINCT, SUM, MIN, MAX, AVG) AS ?x,
triple patterns with ``a``, ``;`` and ``,``, property paths (``/ | ^ + * ?`` and parentheses), FILTER, OPTIONAL, UNION, MINUS,
GROUP BY, HAVING (an aggregate or a name compared with a number), ORDER BY, LIMIT and OFFSET. Anything else is an error. Results are bags; a variable shared by patterns agrees on
its value and on whether it is a literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .materialize import RulePlanner

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(r"""\s*(?:\#[^\n]*\n\s*)*(<[^<>\s]*>|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\?\w+|\$\w+|[A-Za-z_][\w-]*:(?:[\w-]+(?:\.[\w-]+)*)?|:(?:[\w-]+(?:\.[\w-]+)*)?|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|&&|\|\||!=|<=|>=|[{}().;,*+=<>!|/^?])""")
_WORDS = {"PREFIX", "SELECT", "DISTINCT", "WHERE", "FILTER", "OPTIONAL", "UNION", "MINUS", "GROUP", "HAVING", "ORDER", "BY", "LIMIT", "OFFSET", "ASC", "DESC", "AS", "COUNT", "SUM", "MIN", "MAX", "AVG", "REGEX", "BOUND", "STR"}


class QueryError(ValueError):
    """The text is no query of the supported subset."""


def _unescape(body: str) -> str:
    """Backslash escapes of a string token; characters outside ASCII stand as they are."""
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)


@dataclass
class Term:
    kind: str  # var, iri, literal
    value: str


@dataclass
class Pattern:
    s: Term
    p: Term
    o: Term
    #: A path instead of the predicate: ("iri", name), ("seq" | "alt", left, right), ("inverse" | "+" | "*" | "?", path).
    path: tuple | None = None


@dataclass
class Group:
    items: list = field(default_factory=list)  # Pattern, ("filter", expr), ("optional"|"minus", Group), ("union", [Group])


@dataclass
class Query:
    columns: list  # names, or (function, distinct, argument, name)
    distinct: bool
    where: Group
    group_by: list[str]
    having: list[tuple]
    order_by: list[tuple[str, bool]]
    limit: int | None
    offset: int


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unreadable text at {text[at : at + 30]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0
        self.prefixes = dict(prefixes or {})

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def word(self, *names: str) -> bool:
        return self.peek().upper() in names

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise QueryError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, token: str) -> None:
        if (got := self.next()).upper() != token:
            raise QueryError(f"{token} expected, not {got}")

    def query(self) -> Query:
        while self.word("PREFIX"):
            self.next()
            name = self.next()
            if not name.endswith(":") and name != ":":
                raise QueryError(f"a prefix expected, not {name}")
            self.prefixes[name[:-1]] = self.next()[1:-1]
        self.expect("SELECT")
        distinct = self.word("DISTINCT")
        if distinct:
            self.next()
        columns: list = []
        while not self.word("WHERE", "{"):
            t = self.next()
            if t == "*":
                columns.append("*")
            elif t[0] in "?$":
                columns.append(t[1:])
            elif t == "(":
                columns.append(self.aggregate())
            else:
                raise QueryError(f"{t} can't be selected")
        if self.word("WHERE"):
            self.next()
        where = self.group()
        group_by: list[str] = []
        having: list[tuple] = []
        order_by: list[tuple[str, bool]] = []
        limit, offset = None, 0
        while self.peek():
            if self.word("GROUP"):
                self.next()
                self.expect("BY")
                while self.peek()[:1] in ("?", "$"):
                    group_by.append(self.next()[1:])
            elif self.word("HAVING"):
                self.next()
                while self.peek() == "(":
                    having.append(self.having())
            elif self.word("ORDER"):
                self.next()
                self.expect("BY")
                while self.peek()[:1] in ("?", "$") or self.word("ASC", "DESC"):
                    down = self.word("DESC")
                    if self.word("ASC", "DESC"):
                        self.next()
                        self.expect("(")
                        order_by.append((self.next()[1:], down))
                        self.expect(")")
                    else:
                        order_by.append((self.next()[1:], False))
            elif self.word("LIMIT"):
                self.next()
                limit = int(self.next())
            elif self.word("OFFSET"):
                self.next()
                offset = int(self.next())
            else:
                raise QueryError(f"{self.peek()} isn't supported")
        return Query(columns, distinct, where, group_by, having, order_by, limit, offset)

    def call(self) -> tuple:
        """An aggregate: (function, distinct, argument)."""
        name = self.next().upper()
        if name not in ("COUNT", "SUM", "MIN", "MAX", "AVG"):
            raise QueryError(f"{name} isn't supported")
        self.expect("(")
        distinct = self.word("DISTINCT")
        if distinct:
            self.next()
        arg = self.next()
        self.expect(")")
        return (name, distinct, arg if arg == "*" else arg[1:])

    def aggregate(self) -> tuple:
        made = self.call()
        self.expect("AS")
        alias = self.next()[1:]
        self.expect(")")
        return (*made, alias)

    def having(self) -> tuple:
        """(name or aggregate, comparison, number)."""
        self.expect("(")
        left = self.next()[1:] if self.peek()[:1] in ("?", "$") else self.call()
        op, number = self.next(), self.next()
        self.expect(")")
        if op not in ("=", "!=", "<", ">", "<=", ">=") or not re.fullmatch(r"-?\d+(\.\d+)?", number):
            raise QueryError("HAVING compares with a number")
        return (left, op, float(number))

    def term(self, predicate: bool = False) -> Term:
        t = self.next()
        if t[0] in "?$":
            return Term("var", t[1:])
        if t[0] == "<":
            return Term("iri", t[1:-1])
        if t[0] in "\"'":
            return Term("literal", _unescape(t[1:-1]))
        if predicate and t == "a":
            return Term("iri", TYPE)
        if re.fullmatch(r"-?\d+(\.\d+)?", t):
            return Term("literal", t)
        if ":" in t:
            prefix, local = t.split(":", 1)
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix}:")
            return Term("iri", self.prefixes[prefix] + local)
        raise QueryError(f"{t} is no term")

    def group(self) -> Group:
        self.expect("{")
        out = Group()
        while self.peek() != "}":
            if self.word("FILTER"):
                self.next()
                out.items.append(("filter", self.expression() if self.peek() == "(" else self.atom()))
            elif self.word("OPTIONAL", "MINUS"):
                kind = self.next().lower()
                out.items.append((kind, self.group()))
            elif self.peek() == "{":
                parts = [self.group()]
                while self.word("UNION"):
                    self.next()
                    parts.append(self.group())
                out.items.append(("union", parts))
            else:
                self.patterns(out)
            if self.peek() == ".":
                self.next()
        self.next()
        return out

    def patterns(self, out: Group) -> None:
        s = self.term()
        while True:
            p, path = (self.term(), None) if self.peek()[:1] in ("?", "$") else (None, self.path())
            if path and path[0] == "iri":
                p, path = Term("iri", path[1]), None
            while True:
                out.items.append(Pattern(s, p or Term("path", ""), self.term(), path))
                if self.peek() != ",":
                    break
                self.next()
            if self.peek() != ";":
                break
            self.next()

    # paths: nested tuples
    def path(self) -> tuple:
        left = self.sequence()
        while self.peek() == "|":
            self.next()
            left = ("alt", left, self.sequence())
        return left

    def sequence(self) -> tuple:
        left = self.step()
        while self.peek() == "/":
            self.next()
            left = ("seq", left, self.step())
        return left

    def step(self) -> tuple:
        if self.peek() == "^":
            self.next()
            return ("inverse", self.step())
        if self.peek() == "(":
            self.next()
            out = self.path()
            self.expect(")")
        else:
            t = self.term(predicate=True)
            if t.kind != "iri":
                raise QueryError("a path is made of predicates")
            out = ("iri", t.value)
        while self.peek() in ("+", "*", "?"):
            out = (self.next(), out)
        return out

    # expressions: nested tuples
    def expression(self):
        left = self.conjunction()
        while self.peek() == "||":
            self.next()
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.peek() == "&&":
            self.next()
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.atom()
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            return ("cmp", self.next(), left, self.atom())
        return left

    def atom(self):
        if self.peek() == "!":
            self.next()
            return ("not", self.atom())
        if self.peek() == "(":
            self.next()
            out = self.expression()
            self.expect(")")
            return out
        if self.word("REGEX", "BOUND", "STR"):
            name = self.next().lower()
            self.expect("(")
            args = [self.atom()]
            while self.peek() == ",":
                self.next()
                args.append(self.atom())
            self.expect(")")
            return (name, *args)
        return ("term", self.term())


def _lit(var: str) -> str:
    return f"{var}__lit"


class Compiler:
    """Solutions are frames with two columns a variable: its value and whether it is a literal."""

    def __init__(self, triples: DataFrame | RulePlanner):
        """``triples``: facts, or the planner of rules, of which each pattern then plans those that can give it something."""
        self.source = triples

    def facts(self, predicate: str | None = None, class_: str | None = None) -> DataFrame:
        if isinstance(self.source, DataFrame):
            return self.source
        return self.source.graph(predicate, class_)

    def aggregate(self, name: str, distinct: bool, arg: str, variables: list[str]) -> Column:
        if name == "COUNT":
            return (F.count_distinct(*(map(F.col, variables))) if distinct else F.count("*")) if arg == "*" else (F.count_distinct(arg) if distinct else F.count(arg))
        value = F.col(arg).try_cast("double") if name in ("SUM", "AVG") else F.col(arg)
        if name == "AVG" and distinct:
            return F.sum_distinct(value) / F.count_distinct(value)
        return {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](value)

    def run(self, q: Query) -> DataFrame:
        df = self.group(q.where)
        variables = [c for c in df.columns if not c.endswith("__lit")]
        aggregates = [c for c in q.columns if isinstance(c, tuple)]
        if aggregates or q.group_by:
            made = [self.aggregate(*c[:3], variables).alias(c[3]) for c in aggregates]
            made += [self.aggregate(*h[0], variables).alias(f"_having{i}") for i, h in enumerate(q.having) if isinstance(h[0], tuple)]
            df = df.groupBy(*q.group_by).agg(*made) if made else df.select(*q.group_by).distinct()
            for i, (left, op, number) in enumerate(q.having):
                df = df.filter(F.expr(f"`{left if isinstance(left, str) else f'_having{i}'}` {'<>' if op == '!=' else op} {number}"))
            names = [c if isinstance(c, str) else c[3] for c in q.columns]
        elif q.having:
            raise QueryError("HAVING needs groups")
        else:
            names = variables if "*" in q.columns else q.columns
        unknown = [n for n in names if n not in df.columns]
        for n in unknown:
            df = df.withColumn(n, F.lit(None).cast("string"))
        if q.distinct:  # distinct on the pairs of value and kind
            pairs = [c for n in names for c in (n, _lit(n)) if c in df.columns]
            df = df.select(*pairs).distinct()
        if q.order_by:
            df = df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in q.order_by])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*names)

    def group(self, g: Group) -> DataFrame:
        df = self.basic([i for i in g.items if isinstance(i, Pattern)])
        for item in g.items:
            if isinstance(item, Pattern) or item[0] == "filter":
                continue
            kind, body = item
            if kind == "union":
                other = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.group(x) for x in body])
                df = other if df is None else self.join(df, other)
            elif df is None:
                raise QueryError(f"{kind.upper()} needs a pattern before it")
            elif kind == "optional":
                df = self.join(df, self.group(body), "left")
            else:
                other = self.group(body)
                shared = [c for c in df.columns if c in other.columns]
                df = df.join(other.select(*shared).distinct(), shared, "left_anti") if shared else df
        if df is None:
            raise QueryError("a group without patterns")
        for item in g.items:
            if not isinstance(item, Pattern) and item[0] == "filter":
                df = df.filter(self.test(item[1], df))
        return df

    def basic(self, patterns: list[Pattern]) -> DataFrame | None:
        """Patterns with most constants first, each next one sharing a variable with those before where there is one."""
        left = sorted(patterns, key=lambda p: -sum(t.kind != "var" for t in (p.s, p.o)))
        df: DataFrame | None = None
        while left:
            bound = {c for c in df.columns} if df is not None else set()
            pick = next((p for p in left if {t.value for t in (p.s, p.p, p.o) if t.kind == "var"} & bound), left[0])
            left.remove(pick)
            one = self.pattern(pick)
            df = one if df is None else self.join(df, one)
        return df

    def pattern(self, p: Pattern) -> DataFrame:
        if p.path:
            t = self.pairs(p.path, [x.value for x in (p.s, p.o) if x.kind != "var"])
        else:
            t = self.facts(p.p.value if p.p.kind == "iri" else None, p.o.value if p.o.kind == "iri" else None)
        test: Column = F.lit(True)
        columns: dict[str, list[Column]] = {}
        for term, c, literal in ((p.s, "s", F.col("s_literal") if p.path else F.lit(False)), (p.p, "p", F.lit(False)), (p.o, "o", F.col("is_literal"))):
            if term.kind == "var":
                columns.setdefault(term.value, []).append(F.struct(F.col(c).alias("v"), literal.alias("l")))
            elif term.kind != "path":
                test = test & (F.col(c) == term.value)
                if c == "o":
                    test = test & (F.col("is_literal") == F.lit(term.kind == "literal"))
        t = t.filter(test)
        for same in columns.values():
            for other in same[1:]:
                t = t.filter((same[0]["v"] == other["v"]) & (same[0]["l"] == other["l"]))
        out = [x for name, same in columns.items() for x in (same[0]["v"].alias(name), same[0]["l"].alias(_lit(name)))]
        return t.select(*out) if out else t.select(F.lit(True).alias("_there"), F.lit(False).alias(_lit("_there")))

    def pairs(self, path: tuple, constants: list[str]) -> DataFrame:
        """(s, s_literal, o, is_literal) that a path joins. Paths of any length are sets, the others bags."""
        kind = path[0]
        names = ["s", "s_literal", "o", "is_literal"]
        if kind == "iri":
            return self.facts(path[1]).filter(F.col("p") == path[1]).select("s", F.lit(False).alias("s_literal"), "o", "is_literal")
        if kind == "inverse":
            return self.pairs(path[1], constants).toDF("o", "is_literal", "s", "s_literal").select(*names)
        if kind == "alt":
            return self.pairs(path[1], constants).unionByName(self.pairs(path[2], constants))
        if kind == "seq":
            a = self.pairs(path[1], constants).toDF("s", "s_literal", "_m", "_l")
            b = self.pairs(path[2], constants).toDF("_m", "_l", "o", "is_literal")
            return a.join(b, ["_m", "_l"]).select(*names)
        step = cut(self.pairs(path[1], constants).distinct())
        every, fresh = step, step
        while kind != "?":
            on = (F.col("a.o") == F.col("b.s")) & (F.col("a.is_literal") == F.col("b.s_literal"))
            new = fresh.alias("a").join(step.alias("b"), on).select("a.s", "a.s_literal", "b.o", "b.is_literal").distinct()
            new = cut(new.join(every, names, "left_anti"))
            if new.isEmpty():
                break
            every, fresh = every.unionByName(new), new
        if kind != "+":  # and no step at all: every node with itself, and the pattern's own terms
            all_ = self.facts()
            nodes = all_.select("s", F.lit(False).alias("l")).union(all_.select("o", "is_literal"))
            for c in constants:
                nodes = nodes.union(all_.sparkSession.range(1).select(F.lit(c), F.lit(False)))
            every = every.unionByName(nodes.distinct().select("s", F.col("l").alias("s_literal"), F.col("s").alias("o"), F.col("l").alias("is_literal"))).distinct()
        return every

    def join(self, a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if shared:
            return a.join(b, shared, how)
        return a.join(b, F.lit(True), how)  # patterns without a shared variable: the query asks for all combinations

    def test(self, e, df: DataFrame) -> Column:
        kind = e[0]
        if kind in ("and", "or"):
            a, b = self.test(e[1], df), self.test(e[2], df)
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.test(e[1], df)
        if kind == "bound":
            name = e[1][1].value
            return F.col(name).isNotNull() if name in df.columns else F.lit(False)
        if kind == "regex":
            flags = "(?i)" if len(e) > 3 and "i" in e[3][1].value else ""
            return self.value(e[1], df).rlike(flags + e[2][1].value)
        if kind == "cmp":
            op, a, b = e[1], e[2], e[3]
            x, y = self.value(a, df), self.value(b, df)
            if any(z[0] == "term" and z[1].kind == "literal" and re.fullmatch(r"-?\d+(\.\d+)?", z[1].value) for z in (a, b)):
                x, y = x.try_cast("double"), y.try_cast("double")
            return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        raise QueryError(f"{kind} is no test")

    def value(self, e, df: DataFrame) -> Column:
        if e[0] == "str":
            return self.value(e[1], df)
        if e[0] != "term":
            raise QueryError(f"{e[0]} is no value")
        t = e[1]
        if t.kind != "var":
            return F.lit(t.value)
        return F.col(t.value) if t.value in df.columns else F.lit(None).cast("string")


def graph_query(triples: DataFrame | RulePlanner, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The answer of a query text over (s, p, o, is_literal), or over the facts that a planner's rules give."""
    return Compiler(triples).run(Parser(text, prefixes).query())
