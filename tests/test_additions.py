import json
import random

import pytest
from pyspark.sql import functions as F

from trelliq.catalog import Catalog, Column, ForeignKey, TableMeta
from trelliq.functions import text
from trelliq.operators import coverage, decisions, evaluation, lake, markdown, requests, retrieval
from trelliq.plans import compiler, materialize, program
from trelliq.plans.compiler import Match
from trelliq.plans.graphquery import QueryError, graph_query
from trelliq.plans.rules import RowFilter
from trelliq.scenario import arguments, read_config
from trelliq.sources import files, vector_store
from trelliq.sources.rdfxml import is_rdfxml, parse_rdfxml
from trelliq.sources.turtle import parse_turtle

EX = "http://ex#"


def meta(name, columns, pk="", **fks):
    made = tuple(Column(c.split(":")[0], (c.split(":") + ["text"])[1]) for c in columns.split())
    return TableMeta(name, made, tuple(pk.split()), tuple(ForeignKey((c,), r.split(".")[0], (r.split(".")[1],)) for c, r in fks.items()))


# --- rules from matches


def test_discriminators_give_class_rules():
    cat = Catalog.of([meta("persons", "id is_author_of_paper student:boolean name", "id"), meta("papers", "id type title", "id"), meta("registration_fees", "id amount", "id")])
    rules = compiler.compile_rules([Match("source-class:persons", EX + "Person"), Match("source-class:papers", EX + "Paper"), Match("source-class:registration_fees", EX + "Registration"), Match("source-data:papers.type", EX + "kind")], cat)
    got = {(r.source_table, r.target.removeprefix(EX), r.row_filter) for r in rules}
    assert {("persons", n, RowFilter("is_author_of_paper", truthy=True)) for n in ("author_of_paper", "Author_of_paper", "Author")} <= got
    assert ("persons", "Student", RowFilter("student", truthy=True)) in got
    assert {("papers", "PaperFullVersion", RowFilter("type", equals="1")), ("papers", "PaperAbstract", RowFilter("type", equals="2"))} <= got
    assert {("registration_fees", "Registration_fee", None), ("registration_fees", "Fee", None)} <= got
    assert all(r.kind == "class" for r in rules)  # a type column is no literal


def test_identifiers_are_literals_only_where_both_sides_name_one():
    cat = Catalog.of([meta("papers", "id isbn paper_id", "paper_id"), meta("books", "isbn_id code", "code", isbn_id="papers.id")])
    base = [Match("source-class:papers", EX + "Paper"), Match("source-class:books", EX + "Book")]
    data = lambda m: [(r.source_table, r.source_column) for r in compiler.compile_rules([*base, m], cat) if r.kind == "data"]
    assert data(Match("source-data:papers.paper_id", EX + "paperID")) == [("papers", "paper_id")]
    assert data(Match("source-data:papers.paper_id", EX + "title")) == []
    assert data(Match("source-data:books.isbn_id", EX + "hasIsbn")) == []
    assert data(Match("source-data:papers.isbn", EX + "hasIsbn")) == [("papers", "isbn")]


def test_join_table_ends_by_name():
    cat = Catalog.of([meta("authors", "id", "id"), meta("papers", "id", "id"), meta("writes", "aid paper", "aid paper", aid="authors.id")])
    assert cat.tables["writes"].role == "join_table"
    rules = compiler.compile_rules([Match("source-class:authors", EX + "Author"), Match("source-class:papers", EX + "Paper"), Match("source-object:writes.aid", EX + "writtenBy", (EX + "Paper",), (EX + "Author",))], cat)
    one = [r for r in rules if r.kind == "object"]
    assert [(r.subject_table, r.subject_columns, r.object_table, r.object_columns) for r in one] == [("papers", ("paper",), "authors", ("aid",))]


@pytest.mark.parametrize(
    "body",
    [
        "    for rule in all_rules('class'):\n        for row in rows(rule):\n            if len(row) == 0:\n                emit_type(row, rule)\n",
        "    for rule in all_rules('class'):\n        emit_type(rule, rule)\n",
        "    for rule in all_rules('class'):\n        for row in rows(rule):\n            emit_data(row, rule)\n",
        "    for rule in all_rules('class'):\n        for row in rows(rule):\n            emit_type(rule, row)\n",
        "    for rule in all_rules():\n        for row in rows(rule):\n            emit_type(row, rule)\n",
        "    emit_type(context, context)\n",
    ],
)
def test_programs_that_are_not_understood(body):
    with pytest.raises(program.ProgramError):
        program.kinds("def materialize(context):\n" + body)


# --- graph patterns

GRAPH = [("urn:a", "urn:knows", "urn:b", False), ("urn:b", "urn:knows", "urn:c", False), ("urn:c", "urn:likes", "urn:a", False), ("urn:a", "urn:age", "9", True), ("urn:b", "urn:age", "9", True), ("urn:c", "urn:age", "12", True)]


@pytest.mark.parametrize(
    "query, want",
    [
        ("SELECT ?x ?y { ?x :knows/:likes ?y }", {("urn:b", "urn:a")}),
        ("SELECT ?x ?y { ?x ^:knows ?y }", {("urn:b", "urn:a"), ("urn:c", "urn:b")}),
        ("SELECT ?y { :a (:knows|:likes)+ ?y }", {("urn:a",), ("urn:b",), ("urn:c",)}),
        ("SELECT ?y { :a :knows* ?y }", {("urn:a",), ("urn:b",), ("urn:c",)}),
        ("SELECT ?y { :z :knows* ?y }", {("urn:z",)}),
        ("SELECT ?y { :a :knows? ?y }", {("urn:a",), ("urn:b",)}),
        ("SELECT ?g { :a :knows/:knows/:age ?g }", {("12",)}),
        ("SELECT ?g (COUNT(?x) AS ?n) { ?x :age ?g } GROUP BY ?g HAVING (?n > 1)", {("9", 2)}),
        ("SELECT ?p (COUNT(*) AS ?n) { ?x ?p ?y } GROUP BY ?p HAVING (COUNT(DISTINCT ?y) = 2)", {("urn:knows", 2), ("urn:age", 3)}),
        ("SELECT (AVG(DISTINCT ?g) AS ?m) (AVG(?g) AS ?n) { ?x :age ?g }", {(10.5, 10.0)}),
    ],
)
def test_paths_and_groups(spark, query, want):
    t = spark.createDataFrame(GRAPH, "s string, p string, o string, is_literal boolean")
    assert {tuple(r) for r in graph_query(t, "prefix : <urn:> " + query).collect()} == want


def test_path_errors(spark):
    t = spark.createDataFrame(GRAPH, "s string, p string, o string, is_literal boolean")
    for q in ("SELECT ?x { ?x (?y) ?z }", "SELECT ?x { ?x :a/ ?z }", "SELECT ?x { ?x :a ?y } HAVING (?x > 1)", "SELECT ?x { ?x :a ?y } GROUP BY ?x HAVING (?x > ?y)"):
        with pytest.raises(QueryError):
            graph_query(t, "prefix : <urn:> " + q)


def test_patterns_plan_only_the_rules_that_they_name(spark, tmp_path):
    from trelliq.queries.base import star_planner

    plan = graph_query(star_planner(spark, "/root/testdata/sf0.001"), "prefix : <urn:tpch:> SELECT ?c { ?c :segment \"BUILDING\" }")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "c_mktsegment" in plan and "o_orderkey" not in plan


# --- sources

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://ex">
  <owl:Class rdf:about="http://ex#Person"><rdfs:label>Person</rdfs:label></owl:Class>
  <owl:Class rdf:ID="Author"><rdfs:subClassOf rdf:resource="#Person"/></owl:Class>
  <rdf:Description rdf:about="#name"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#DatatypeProperty"/><rdfs:domain><owl:Class rdf:about="#Person"/></rdfs:domain></rdf:Description>
</rdf:RDF>"""
TURTLE = """@prefix : <http://ex#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Person a owl:Class ; rdfs:label "Person" . :Author a owl:Class ; rdfs:subClassOf :Person . :name a owl:DatatypeProperty ; rdfs:domain :Person ."""


def test_rdf_xml_reads_like_turtle():
    assert is_rdfxml(XML) and not is_rdfxml(TURTLE)
    assert set(parse_rdfxml(XML)) == set(parse_turtle(TURTLE))


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("ROOT_OF_ALL", "/data")
    (tmp_path / "c.yaml").write_text(json.dumps({"root": "${ROOT_OF_ALL}", "work": "out", "scenarios": ["a", "b"], "top_k": 5, "reports": True, "seed": ""}))
    config = read_config(tmp_path / "c.yaml")
    assert arguments(config) == [["run", "--scenario", f"/data/{s}", "--work", f"out/{s}", "--top-k", "5", "--reports"] for s in "ab"]
    assert arguments(config, "match", "x") == [["match", "--scenario", "/data/x", "--work", "out/x", "--top-k", "5", "--reports"]]
    (tmp_path / "none.yaml").write_text("")
    assert read_config(tmp_path / "none.yaml") == {}


def test_dump_keeps_definitions_and_replaces_rows(spark, tmp_path):
    given = "CREATE TABLE t (a int, b text);\nCOPY public.t (a, b) FROM stdin;\n1\told\n2\told\n\\.\nCOPY u (c) FROM stdin;\n9\n\\.\nALTER TABLE t ADD PRIMARY KEY (a);"
    cat = Catalog.of([meta("t", "a b"), meta("u", "c")])
    rows = spark.createDataFrame([(5, "x\ty"), (6, None)], "a int, b string")
    files.write_dump(given, {"t": rows}, cat, str(tmp_path / "dump"))
    got = [line for p in sorted((tmp_path / "dump").glob("part-*")) for line in p.read_text().splitlines()]
    assert got[:2] == given.splitlines()[:2] and set(got[2:4]) == {"5\tx\\ty", "6\t\\N"} and got[4:] == ["\\.", "COPY u (c) FROM stdin;", "\\.", "ALTER TABLE t ADD PRIMARY KEY (a);"]


def test_ledger_header_moves_to_the_current_one(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files.append_csv_ledger(spark.createDataFrame([("a", 1)], "scenario string, old int"), path, ["scenario", "old"])
    out = files.append_csv_ledger(spark.createDataFrame([("b", 0.5)], "scenario string, f1 double"), path, ["scenario", "f1"])
    assert out.columns == ["scenario", "f1"] and {tuple(r) for r in out.collect()} == {("a", None), ("b", "0.5")}


def test_vector_index_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "id int, text string, embedding array<double>")
    vector_store.write_index(rows, str(tmp_path / "index"), "id")
    assert spark.read.json(str(tmp_path / "index/meta")).columns == ["id", "text"] and spark.read.parquet(str(tmp_path / "index/vectors")).count() == 2
    with pytest.raises(ValueError, match="not_finite"):
        vector_store.checked(spark.createDataFrame([([1.0, float("inf")],), ([1.0, 2.0],)], "embedding array<double>"))
    with pytest.raises(ValueError, match="no embedded"):
        vector_store.checked(rows.limit(0))
    origin = {"provider": "p", "model": "m", "verbalization": "v1"}
    keyed = rows.select(vector_store.cache_key(F.col("text"), **origin).alias("hash"), "embedding")
    path = str(tmp_path / "cache")
    assert vector_store.append_cache(keyed.limit(1), path, **origin).count() == 1
    more = vector_store.append_cache(keyed.union(keyed), path, **origin)
    assert vector_store.read_cache(spark, path, **origin).count() == 2 and more.columns == ["hash", "embedding"]
    assert vector_store.read_cache(spark, path, **{**origin, "model": "other"}).count() == 0


def test_mapping_document():
    doc = materialize.mapping_document(Catalog.of([meta("p", "id", "id"), meta("q", "id p_id", "id", p_id="p.id")]))
    facts = parse_turtle(doc) if "[" not in doc else []
    assert doc.count("rr:TriplesMap") == 2 and "ref-p_id" in doc and 'rr:template "urn:trelliq:direct:p/id={p_id}"' in doc and facts == []


# --- reports


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None), ("c", 1.5)], "name string, f1 double")
    lines = markdown.table(df, ["name", "f1"], ["name"], numbers=("f1",))
    assert lines == ["| name | f1 |", "| --- | ---: |", "| a\\|b |  |", "| c | 1.5 |"]
    markdown.write(["# T", "", *lines, ""], tmp_path / "r" / "t.md")
    assert (tmp_path / "r" / "t.md").read_text().endswith("| c | 1.5 |\n") and not list((tmp_path / "r").glob("*.new"))
    none = spark.createDataFrame([], "id string, name string, f1 double, sql_rows int, graph_rows int, cause string")
    assert markdown.scenario("s", {"F1": 1.0}, none)[-1] == "No failed query pairs."


# --- retrieval and evaluation


def test_holders_of_passages(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 6, 7, 12, 20)]
    docs = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    docs += [f"x{p}y and more {docs[i]}" for i, p in enumerate(passages)] + ["", None, passages[4], passages[4].replace(" ", "  ", 1)]
    d, p = spark.createDataFrame(list(enumerate(docs)), "doc int, text string"), spark.createDataFrame(list(enumerate(passages)), "item int, text string")
    got = {tuple(r) for r in evaluation.holders(d, p, "doc", "item").collect()}
    assert got == {(i, k) for k, t in enumerate(docs) for i, x in enumerate(passages) if t and x in t}


def test_dense_blocks_agree_with_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, kind int, vector array<double>")
    top = retrieval.dense_top(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", 5)
    best = lambda x: {(r.a, r.b) for r in retrieval.ranked(x, "a", "b", F.round("score", 6), 5).collect()}
    assert best(top) == best(retrieval.dense(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b"))


def test_every_target_in_blocks(spark, monkeypatch):
    s, t = spark.createDataFrame([("a",), ("b",)], "source string"), spark.createDataFrame([(f"t{i}",) for i in range(9)], "target string")
    whole = {tuple(r) for r in retrieval.every_target(s, t).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 4)
    assert {tuple(r) for r in retrieval.every_target(s, t).collect()} == whole and len(whole) == 18


def test_candidate_evaluation(spark):
    ranks = [("s", "bm25", "a", "t1", 2.0, 1), ("s", "bm25", "a", "t2", 1.0, 2), ("s", "bm25", "b", "t1", 1.0, 1), ("s", "bm25", "b", "t2", 1.0, 2), ("s", "dense", "a", "t2", 0.9, 1), ("s", "dense", "b", "t9", 0.8, 1)]
    rankings = spark.createDataFrame(ranks, "scenario string, method string, source string, target string, score double, rank int")
    gold = spark.createDataFrame([("s", "a", "t1"), ("s", "b", "t7"), ("s", "c", "t1")], "scenario string, source string, target string")
    sources = spark.createDataFrame([("s", x, "class" if x != "c" else "data", "r") for x in "abc"], "scenario string, source string, kind string, role string")
    out = evaluation.candidate_evaluation(rankings, gold, sources)
    assert out["details"].count() == 6
    assert {(r.method, r.source, r.failure_category) for r in out["failures"].collect()} == {("bm25", "b", "ambiguous_candidates"), ("bm25", "c", "zero_candidates"), ("dense", "a", "dense_semantic_failure"), ("dense", "b", "dense_semantic_failure"), ("dense", "c", "zero_candidates")}
    one = {(r.method, r.kind): r.recall_at_k for r in out["metrics_overall"].filter("k = 1").collect()}
    assert one[("bm25", "class")] == 0.5 and abs(one[("bm25", "all")] - 1 / 3) < 1e-9 and one[("dense", "all")] == 0
    assert [tuple(r) for r in out["best_methods"].select("scenario", "method", "difficult").collect()] == [("s", "bm25", True)]
    lines = markdown.candidates(out["metrics_overall"].filter("kind = 'all'"), out["metrics_by_scenario"].filter("kind = 'all'"), out["best_methods"])
    assert lines[0] == "# Candidate generation" and any(x.startswith("| s | bm25 |") for x in lines)


def test_artifacts_of_another_origin(spark):
    rows = spark.createDataFrame([("a", 1, "t", "p"), ("b", 1, "t", "q")], "source string, rank int, target string, provider string")
    records = spark.createDataFrame([("t", "label")], "target string, label string")
    with pytest.raises(Exception, match="incompatible: q"):
        decisions.load_artifact(rows, rows.select("source"), records, 3, provider="p").collect()
    lost = spark.createDataFrame([("a",), ("z",)], "source string")
    with pytest.raises(Exception, match="no artifact row for z"):
        decisions.load_artifact(rows.filter("provider = 'p'"), lost, records, 3, provider="p").collect()


# --- requests and answers


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, 30) for i in range(5)] + [(2, 0, 10)], "c int, i int, size int")
    got = {(r.c, r.i): r.part for r in requests.halved(rows, "c", "i", "size", 70).collect()}
    assert got == {(1, 0): "0", (1, 1): "0", (1, 2): "10", (1, 3): "11", (1, 4): "11", (2, 0): ""}
    with pytest.raises(Exception, match="exceeds the budget"):
        requests.halved(rows, "c", "i", "size", 20).collect()


def test_json_bodies(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', 'so: [{"a": 1}] done', "nothing", "", None, "{broken"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(text.json_body(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 1}', '[{"a": 1}]', None, None, None, None]


# --- lakes of schemas


def test_lake_agrees_with_the_catalog(spark):
    cat = Catalog.of([meta("person", "id is_new:boolean type name", "id"), meta("author", "id", "id", id="person.id"), meta("paper", "id title by", "id", by="author.id"), meta("writes", "aid pid", "aid pid", aid="author.id", pid="paper.id"), meta("alone", "x y")])
    columns = spark.createDataFrame([(t.name, i, c.name, c.datatype, c.name in t.primary_key) for t in cat.tables.values() for i, c in enumerate(t.columns)], "table_name string, position int, column_name string, datatype string, is_pk boolean")
    keys = spark.createDataFrame([(t.name, k, c, fk.ref_table, r) for t in cat.tables.values() for k, fk in enumerate(t.foreign_keys) for c, r in zip(fk.columns, fk.ref_columns, strict=True)], "child string, key_id int, column_name string, parent string, ref_column string")
    assert {(r.table_name, r.role, r.join_like) for r in lake.table_roles(columns, keys).collect()} == {(t.name, t.role, t.join_like) for t in cat.tables.values()}
    assert {(r.table_name, r.column_name, r.column_role) for r in lake.column_roles(columns, keys).collect()} == {(t.name, c, t.column_role(c)) for t in cat.tables.values() for c in t.names}
    assert {tuple(r) for r in lake.edges(columns, keys).collect()} == set(cat.edges())
    from trelliq.operators.patterns import patterns
    from trelliq.operators.profiling import components

    assert {(r.pattern_type, r.table_name, r["columns"], r.score) for r in lake.patterns(columns, keys).collect()} == set(patterns(cat))
    by = {}
    for n, t in components(cat):
        by.setdefault(n, []).append(t)
    assert {(min(ts), t) for ts in by.values() for t in ts} == {tuple(r) for r in lake.components(columns, keys).collect()}


def test_repairs_of_an_empty_set(spark):
    rules = spark.createDataFrame([], "position int, source_table string, source_column string, target string, match_ids array<string>")
    actions = spark.createDataFrame([(1, "drop", 0, False, "t", "c", "u", ["m"])], "action_id int, action string, position int, has_rule boolean, source_table string, source_column string, target string, match_ids array<string>")
    matches = spark.createDataFrame([], "source_id string, target string, table_name string, column_name string")
    columns = spark.createDataFrame([], "table_name string, column_name string")
    kept, rejected = coverage.repairs(rules, actions, matches, columns)
    assert kept.count() == 0 and [r.reason for r in rejected.collect()] == ["unsupported_action_or_missing_rule"]
