"""A reader of the Turtle subset that ontologies and graphs here need, and of N-Triples lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
_TOKEN = re.compile(r"""\s*(?:\#[^\n]*(?:\n|$)\s*)*(<[^<>\s]*>|_:\w+|\"\"\"(?:.|\n)*?\"\"\"|"(?:[^"\\\n]|\\.)*"|@[A-Za-z-]+|\^\^|[A-Za-z_][\w-]*:[\w-]*(?:\.[\w-]+)*|:[\w-]+(?:\.[\w-]+)*|:(?=\s)|-?\d+(?:\.\d+)?|[A-Za-z]+|[\[\].;,()])""")


class TurtleError(ValueError):
    """The text isn't of the subset that is read."""


def _unquote(token: str) -> str:
    body = token[3:-3] if token.startswith('"""') else token[1:-1]
    return re.sub(r'\\(["\\nrt])', lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), body)


def parse_turtle(text: str) -> list[tuple[str, str, str, bool]]:
    """(s, p, o, is_literal) of each statement; subjects and objects of blank nodes keep their ``_:`` label."""
    tokens, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unreadable text at {text[at : at + 30]!r}")
        tokens.append(m[1])
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str, bool]] = []
    i = 0

    def term(t: str) -> tuple[str, bool]:
        if t[0] == "<":
            return t[1:-1], False
        if t.startswith("_:"):
            return t, False
        if t[0] == '"':
            return _unquote(t), True
        if t == "a":
            return TYPE, False
        if ":" in t:
            p, local = t.split(":", 1)
            if p not in prefixes:
                raise TurtleError(f"unknown prefix {p}:")
            return prefixes[p] + local, False
        if re.fullmatch(r"-?\d+(\.\d+)?|true|false", t):
            return t, True
        raise TurtleError(f"{t} isn't supported")

    while i < len(tokens):
        if tokens[i].lower() in ("@prefix", "prefix"):
            prefixes[tokens[i + 1][:-1]] = tokens[i + 2][1:-1]
            i += 4 if tokens[i].startswith("@") else 3
            continue
        s, _ = term(tokens[i])
        i += 1
        while True:
            p, _ = term(tokens[i])
            i += 1
            while True:
                o, literal = term(tokens[i])
                i += 1
                if i < len(tokens) and literal and tokens[i].startswith("@"):
                    i += 1
                if i < len(tokens) and tokens[i] == "^^":
                    i += 2
                out.append((s, p, o, literal))
                if i < len(tokens) and tokens[i] == ",":
                    i += 1
                    continue
                break
            if i < len(tokens) and tokens[i] == ";":
                i += 1
                if tokens[i] == ".":
                    break
                continue
            break
        if i >= len(tokens) or tokens[i] != ".":
            raise TurtleError("a statement without its end")
        i += 1
    return out


def triples_frame(spark: SparkSession, triples: list[tuple[str, str, str, bool]]) -> DataFrame:
    return spark.createDataFrame(triples, "s string, p string, o string, is_literal boolean")


def read_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples lines as (s, p, o, is_literal); other lines give no row. Distributed, one scan."""
    line = r'^\s*(?:<([^>]*)>|(_:\w+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\w+)|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    part = lambda k: F.regexp_extract("value", line, k)
    literal = F.col("value").rlike(r'"\s*(@[\w-]+|\^\^<[^>]*>)?\s*\.\s*$')
    text = part(6)
    for mark, char in ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\"", '"'), (r"\\", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return spark.read.text(path).filter(F.col("value").rlike(line)).select(F.concat(part(1), part(2)).alias("s"), part(3).alias("p"), F.when(literal, text).otherwise(F.concat(part(4), part(5))).alias("o"), literal.alias("is_literal"))


def ontology_records(triples: DataFrame) -> DataFrame:
    """Classes, properties and the two annotations as records: kind, uri, local_name, label, comment, domain, range, parents.

    Blank subjects are none. A plain property is a data property; a data property whose range is a known class is an
    object property.
    """
    kind = F.when(F.col("o").isin(OWL + "Class", RDFS + "Class"), "class").when(F.col("o") == OWL + "ObjectProperty", "object_property").when(F.col("o").isin(OWL + "DatatypeProperty", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"), "data_property")
    typed = triples.filter((F.col("p") == TYPE) & ~F.col("s").startswith("_:")).select(F.col("s").alias("uri"), kind.alias("kind")).filter("kind is not null")
    order = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "object_property", 1).otherwise(2)
    typed = typed.groupBy("uri").agg(F.min_by("kind", order).alias("kind"))
    listed = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    about = triples.groupBy(F.col("s").alias("uri")).agg(
        F.min(F.when(F.col("p") == RDFS + "label", F.col("o"))).alias("label"),
        F.min(F.when(F.col("p") == RDFS + "comment", F.col("o"))).alias("comment"),
        listed(RDFS + "domain").alias("domain"),
        listed(RDFS + "range").alias("range"),
        listed(RDFS + "subClassOf").alias("parents"),
    )
    classes = typed.filter("kind = 'class'").agg(F.collect_set("uri").alias("classes"))
    found = typed.join(about, "uri").join(F.broadcast(classes))  # one row
    found = found.withColumn("kind", F.when((F.col("kind") == "data_property") & F.arrays_overlap("range", "classes"), "object_property").otherwise(F.col("kind"))).drop("classes")
    spark = triples.sparkSession
    none = F.array().cast("array<string>")
    notes = spark.createDataFrame([(RDFS + n, "data_property") for n in ("label", "comment")], "uri string, kind string")
    notes = notes.join(typed.select("uri"), "uri", "left_anti").select("uri", "kind", F.lit("").alias("label"), F.lit("").alias("comment"), none.alias("domain"), none.alias("range"), none.alias("parents"))
    local = F.when(F.contains("uri", F.lit("#")), F.substring_index("uri", "#", -1)).otherwise(F.regexp_extract("uri", "([^/:]*)/*$", 1))
    return found.unionByName(notes).select("kind", "uri", local.alias("local_name"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("comment", F.lit("")).alias("comment"), "domain", "range", "parents")
