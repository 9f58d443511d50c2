from trelliq import cli
from trelliq.scenario import Settings, discover, load
from trelliq.sources.qpair import QueryPair
from trelliq.sources.usage import gold_pairs, graph_targets, sql_use

DUMP = """CREATE TABLE people (id integer, name text, email text);
CREATE TABLE papers (id integer, title text, author_id integer);
ALTER TABLE ONLY people ADD CONSTRAINT a PRIMARY KEY (id);
ALTER TABLE ONLY papers ADD CONSTRAINT b PRIMARY KEY (id);
ALTER TABLE ONLY papers ADD CONSTRAINT c FOREIGN KEY (author_id) REFERENCES people(id);
COPY people (id, name, email) FROM stdin;
1\tAda\tada@example.org
2\tGrace\tgrace@example.org
\\.
COPY papers (id, title, author_id) FROM stdin;
10\tEngines\t1
11\tCompilers\t2
\\.
"""
ONTOLOGY = """@prefix : <http://ex#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:People a owl:Class . :Papers a owl:Class .
:email a owl:DatatypeProperty ; rdfs:domain :People . :title a owl:DatatypeProperty ; rdfs:domain :Papers . :name a owl:DatatypeProperty ; rdfs:domain :People .
:author a owl:ObjectProperty ; rdfs:domain :Papers ; rdfs:range :People .
"""


def scenario(tmp_path):
    folder = tmp_path / "mini"
    (folder / "queries").mkdir(parents=True)
    (folder / "dump.sql").write_text(DUMP)
    (folder / "ontology.ttl").write_text(ONTOLOGY)
    (folder / "queries" / "Q01.qpair").write_text("id = Q01\nsql = SELECT email FROM people\nsparql = PREFIX : <http://ex#> SELECT ?e WHERE { ?p :email ?e }\n")
    (folder / "queries" / "Q02.qpair").write_text("id = Q02\nsql = SELECT p.email, a.title FROM people p JOIN papers a ON a.author_id = p.id\nsparql = PREFIX : <http://ex#> SELECT ?e ?t WHERE { ?a :author ?p ; :title ?t . ?p :email ?e }\n")
    (folder / "queries" / "Q03.qpair").write_text("id = Q03\nsql = nonsense\nsparql = nonsense\ndisabled = 1\n")
    return folder


def test_run(spark, tmp_path):
    folder = scenario(tmp_path)
    assert discover(tmp_path) == ["mini"]
    cli.main(["run", "--scenario", str(folder), "--work", str(tmp_path / "work")])
    got = {r.query_id: r.f1 for r in spark.read.parquet(str(tmp_path / "work" / "metrics")).collect()}
    assert got == {"Q01": 1.0, "Q02": 1.0}
    assert spark.read.parquet(str(tmp_path / "work" / "rules")).count() >= 6
    cli.main(["devset", "--scenario", str(folder), "--work", str(tmp_path / "work"), "--fraction", "1.0"])
    assert spark.read.text(str(tmp_path / "work" / "devset" / "papers")).count() == 2


def test_usage(spark, tmp_path):
    cat = load(spark, scenario(tmp_path)).catalog
    use = sql_use("SELECT p.email, title FROM people AS p JOIN papers ON author_id = p.id", cat)
    assert use.tables == ["people", "papers"] and {("people", "email"), ("papers", "title"), ("papers", "author_id"), ("people", "id")} == set(use.columns)
    assert graph_targets("PREFIX ex: <http://ex#> PREFIX rdf: <u:> SELECT ?x { ?x rdf:type ex:A ; <urn:b> ?y }") == ["urn:b", "http://ex#A"]
    kinds = {"http://ex#People": "class", "http://ex#email": "data_property", "http://ex#author": "object_property", "http://ex#Papers": "class"}
    pair = lambda sql, body: QueryPair("q", "", sql, f"PREFIX : <http://ex#> SELECT ?x {{ {body} }}", (), False)
    assert gold_pairs(pair("SELECT email FROM people", "?p :email ?x"), cat, kinds)[0] == [("source-data:people.email", "http://ex#email")]
    assert gold_pairs(pair("SELECT author_id FROM papers", "?p :author ?x"), cat, kinds)[0] == [("source-object:papers.author_id", "http://ex#author")]
    assert gold_pairs(pair("SELECT COUNT(*)", "?x a :Papers"), cat, kinds) == ([], [("http://ex#Papers", "source_not_in_gold")])


def test_settings(monkeypatch):
    monkeypatch.setenv("WHERE", "mini")
    s = Settings.of({"scenario": "${WHERE}", "top_k": "20", "sample_fraction": "0.5"})
    assert (s.scenario, s.top_k, s.sample_fraction) == ("mini", 20, 0.5)
