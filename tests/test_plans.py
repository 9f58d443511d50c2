import pytest
from pyspark.sql import functions as F

from trelliq.catalog import Catalog, Column, ForeignKey, TableMeta
from trelliq.plans import compiler, materialize, program
from trelliq.plans.compiler import Match
from trelliq.plans.graphquery import QueryError, graph_query
from trelliq.plans.materialize import BASE, TYPE, RulePlanner
from trelliq.plans.rules import Rule, RowFilter

EX = "http://ex#"


def meta(name, columns, pk="", **fks):
    return TableMeta(name, tuple(Column(c) for c in columns.split()), tuple(pk.split()), tuple(ForeignKey((c,), *[(r.split(".")[0]), (r.split(".")[1],)]) for c, r in fks.items()))


def rows(spark, columns, *values):
    return spark.createDataFrame(list(values), ", ".join(f"{c} string" for c in columns.split()))


MINI = Catalog.of([meta("people", "id name email", "id"), meta("papers", "id title author_id", "id", author_id="people.id")])


def mini(spark):
    return {"people": rows(spark, "id name email", ("1", "Ada", "ada@example.org"), ("2", "Grace", "")), "papers": rows(spark, "id title author_id", ("10", "Engines", "1"), ("11", "Compilers", "2"), ("12", "Lost", "9"), ("13", "None", None))}


def test_end_to_end(spark):
    rules = compiler.compile_rules([Match("source-class:people", EX + "Person"), Match("source-class:papers", EX + "Paper"), Match("source-data:people.email", EX + "email", (EX + "Person",)), Match("source-object:papers.author_id", EX + "hasAuthor", (EX + "Paper",), (EX + "Person",))], MINI)
    p = RulePlanner("mini", MINI, mini(spark), rules)
    got = {(r.s, r.p, r.o) for r in p.graph().collect()}
    assert (BASE + "mini/papers/10", EX + "hasAuthor", BASE + "mini/people/1") in got
    assert (BASE + "mini/people/1", EX + "email", "ada@example.org") in got
    assert sum(t[1] == EX + "hasAuthor" for t in got) == 2 and sum(t[1] == EX + "email" for t in got) == 1
    stats = {(r.rule_id, r.outcome): r.n for r in p.stats().collect()}
    assert stats[("data:0", "empty_source_value")] == 1
    assert stats[("object:0", "missing_target_row")] == 1 and stats[("object:0", "missing_target_key")] == 1 and stats[("object:0", "emitted")] == 2


def test_identity_chain_and_missing_parent(spark):
    cat = Catalog.of([meta("persons", "id", "id"), meta("authors", "id", "id", id="persons.id"), meta("papers", "id author", "id", author="authors.id"), meta("full", "id", "id", id="papers.id")])
    frames = {"authors": rows(spark, "id", ("1",)), "papers": rows(spark, "id author", ("10", "1")), "full": rows(spark, "id", ("10",), ("",))}
    rules = [Rule("class", "authors", EX + "Author"), Rule("class", "full", EX + "Full"), Rule("object", "papers", EX + "hasAuthor", source_columns=("author",), target_table="authors")]
    got = {(r.s, r.p, r.o) for r in RulePlanner("x", cat, frames, rules).graph().collect()}
    assert (BASE + "x/persons/1", TYPE, EX + "Author") in got  # the parent's row isn't asked for
    assert (BASE + "x/papers/10", TYPE, EX + "Full") in got and (BASE + "x/full/id", TYPE, EX + "Full") in got
    assert (BASE + "x/papers/10", EX + "hasAuthor", BASE + "x/persons/1") in got


def test_iri_parts(spark):
    t = Catalog.of([meta("t", "a b", "a b")])
    df = rows(spark, "a b", ("x y", "z-1"), (None, "k"), ("", "k"), (None, None))
    got = [r.s.rsplit("/", 1)[1] for r in RulePlanner("s", t, {"t": df}, [Rule("class", "t", EX + "T")]).triples().collect()]
    assert got == ["x_y_z_1", "k", "id_k", "row"]


def test_filters_and_unescape(spark):
    t = Catalog.of([meta("t", "id f c", "id")])
    df = rows(spark, "id f c", ("1", " T ", r"a\nb"), ("2", "no", None), ("3", None, "x"))
    many = [Rule("class", "t", EX + "A", row_filter=RowFilter("f", truthy=True)), Rule("class", "t", EX + "B", row_filter=RowFilter("f", equals="none")), Rule("data", "t", EX + "c", source_column="c")]
    got = {(r.s[-1], r.o) for r in RulePlanner("s", t, {"t": df}, many).triples().collect()}
    assert got == {("1", EX + "A"), ("3", EX + "B"), ("1", "a\nb"), ("3", "x")}


def test_association_and_inverse(spark):
    cat = Catalog.of([meta("c", "id", "id"), meta("m", "id", "id"), meta("cm", "cid mid", "cid mid", cid="c.id", mid="m.id")])
    frames = {"c": rows(spark, "id", ("1",)), "m": rows(spark, "id", ("99",)), "cm": rows(spark, "cid mid", ("1", "99"), ("1", "5"), ("1", "99"))}
    matches = [Match("source-class:c", EX + "C"), Match("source-class:m", EX + "M"), Match("source-class:cm", EX + "Cm"), Match("source-object:cm.cid", EX + "memberOf", (EX + "M",), (EX + "C",))]
    rules = compiler.compile_rules(matches, cat)
    assert [r.source_table for r in rules if r.kind == "class"] == ["c", "m"]
    p = RulePlanner("x", cat, frames, rules)
    got = [(r.s, r.o) for r in p.triples(("object",)).collect()]
    assert got == [(BASE + "x/m/99", BASE + "x/c/1")] * 2 and p.graph().filter(F.col("p") == EX + "memberOf").count() == 1
    frames["m"] = rows(spark, "id", ("7",))
    assert RulePlanner("x", cat, frames, rules).triples(("object",)).count() == 0


def test_existence_trap(spark):
    cat = Catalog.of([meta("p", "a b", "a b"), TableMeta("q", (Column("x"), Column("y")), ("x",), (ForeignKey(("x", "y"), "p", ("b", "a")),))])
    frames = {"p": rows(spark, "a b", ("1", "2")), "q": rows(spark, "x y", ("2", "1"))}
    rule = [Rule("object", "q", EX + "r", source_columns=("x", "y"), target_table="p", target_columns=("b", "a"))]
    assert RulePlanner("s", cat, frames, rule).triples().count() == 0
    assert RulePlanner("s", cat, frames, rule, existence="target_columns").triples().count() == 1


def test_program():
    ok = "def materialize(context):\n    for rule in all_rules('class'):\n        for row in rows(rule):\n            emit_type(row, rule)\n"
    assert program.kinds(ok) == ["class"]
    for bad in ("import os\n", "def materialize(context):\n    open('x')\n", "def materialize(context):\n    while True: pass\n", "def materialize(context):\n    rows.__class__\n", "def other(context):\n    pass\n"):
        with pytest.raises(program.ProgramError):
            program.kinds(bad)


GRAPH = [("urn:a", "urn:knows", "urn:b", False), ("urn:b", "urn:knows", "urn:c", False), ("urn:c", "urn:knows", "urn:a", False), ("urn:a", "urn:name", "Ann", True), ("urn:b", "urn:name", "Bob", True), ("urn:c", "urn:name", "urn:b", True), ("urn:a", "urn:age", "9", True), ("urn:b", "urn:age", "10", True)]


@pytest.mark.parametrize(
    "query, want",
    [
        ("SELECT ?x WHERE { ?x :name ?n FILTER(?n = \"Ann\") }", {("urn:a",)}),
        ("SELECT ?x ?y { ?x :knows+ ?y . ?y :name \"Ann\" }", {("urn:a", "urn:a"), ("urn:b", "urn:a"), ("urn:c", "urn:a")}),
        ("SELECT ?x WHERE { ?x :knows ?y . ?z :name ?y }", set()),  # a literal that reads like an IRI is none
        ("SELECT ?x WHERE { ?x :age ?g FILTER(?g > 9 && !(?g >= 11)) }", {("urn:b",)}),
        ("SELECT ?x ?g WHERE { ?x :name ?n OPTIONAL { ?x :age ?g } FILTER(!bound(?g)) }", {("urn:c", None)}),
        ("SELECT (COUNT(DISTINCT ?y) AS ?n) (MAX(?y) AS ?m) WHERE { ?x :knows ?y }", {(3, "urn:c")}),
        ("SELECT ?x WHERE { { ?x :age ?g } UNION { ?x :name ?n } MINUS { ?x :age \"9\" } }", {("urn:b",), ("urn:c",)}),
        ("SELECT ?x WHERE { ?x :knows ?x }", set()),
        ("SELECT DISTINCT ?p WHERE { :a ?p ?o } ORDER BY ?p LIMIT 2", {("urn:age",), ("urn:knows",)}),
    ],
)
def test_graph_query(spark, query, want):
    t = spark.createDataFrame(GRAPH, "s string, p string, o string, is_literal boolean")
    assert {tuple(r) for r in graph_query(t, "prefix : <urn:> " + query).collect()} == want


@pytest.mark.parametrize("query", ["SELECT ?x", "ASK { ?x ?y ?z }", "SELECT ?x WHERE { ?x nope:y ?z }", "SELECT ?x WHERE { ?x ?y ?z } HAVING ?x"])
def test_graph_query_errors(spark, query):
    t = spark.createDataFrame(GRAPH, "s string, p string, o string, is_literal boolean")
    with pytest.raises(QueryError):
        graph_query(t, query)


def test_invalid_triples(spark):
    t = spark.createDataFrame([("x", "urn:p", "y", True), ("urn:s", "p", "urn:o", False), ("urn:s", "urn:p", "o", False)], "s string, p string, o string, is_literal boolean")
    assert {r.reason for r in materialize.invalid_triples(t).collect()} == {"invalid_subject", "invalid_predicate", "invalid_object"}


def test_fused_scan_is_one(spark, tmp_path):
    rows(spark, "id name email", ("1", "a", "b")).write.parquet(str(tmp_path / "p"))
    rules = [Rule("class", "people", EX + "P"), Rule("data", "people", EX + "n", source_column="name"), Rule("data", "people", EX + "e", source_column="email")]
    plan = RulePlanner("m", MINI, {"people": spark.read.parquet(str(tmp_path / "p"))}, rules).triples()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_streamed_emission(spark, tmp_path):
    from trelliq.streaming.emission import stream_triples

    rows(spark, "id title author_id", ("10", "A", "1"), ("11", "B", "7")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, title string, author_id string").parquet(str(tmp_path / "in"))
    rules = [Rule("class", "papers", EX + "Paper"), Rule("object", "papers", EX + "hasAuthor", source_columns=("author_id",), target_table="people")]
    out = stream_triples("m", MINI, stream, "papers", {"people": mini(spark)["people"]}, rules)
    q = out.writeStream.format("memory").queryName("facts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("facts").count() == 3
