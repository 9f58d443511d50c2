import pytest
from pyspark.sql import functions as F

from trelliq.catalog import Catalog, Column, ForeignKey, TableMeta
from trelliq.sources import copy_blocks, files, qpair, turtle
from trelliq.sources.ddl import parse_ddl, search_path

DUMP = r'''
SET search_path = mini, pg_catalog;
CREATE TABLE people (id integer NOT NULL, name character varying(20) DEFAULT 'a, b', email text);
CREATE TABLE ONLY_X (a int PRIMARY KEY, UNIQUE (a));
CREATE TABLE mini."co-writePaper" ("Co-author" integer, "Paper" integer);
CREATE TABLE papers (id integer, title text, author_id integer);
ALTER TABLE ONLY people ADD CONSTRAINT people_pkey PRIMARY KEY (id);
ALTER TABLE ONLY papers ADD CONSTRAINT p PRIMARY KEY (id);
ALTER TABLE ONLY papers ADD CONSTRAINT f FOREIGN KEY (author_id) REFERENCES people(id);
ALTER TABLE ONLY mini."co-writePaper" ADD CONSTRAINT k PRIMARY KEY ("Co-author", "Paper");
ALTER TABLE ONLY mini."co-writePaper" ADD CONSTRAINT f1 FOREIGN KEY ("Co-author") REFERENCES people;
ALTER TABLE ONLY mini."co-writePaper" ADD CONSTRAINT f2 FOREIGN KEY ("Paper") REFERENCES papers(id);
COPY people (id, name, email) FROM stdin;
1	Ada	ada@example.org
2	Grace	\N
3
\.
COPY mini."co-writePaper" ("Co-author", "Paper") FROM stdin;
1	947
\.
'''


def test_ddl():
    cat = parse_ddl(DUMP)
    people = cat.tables["people"]
    assert people.names == ["id", "name", "email"] and people.primary_key == ("id",)
    assert [c.nullable for c in people.columns] == [False, True, True]
    assert people.columns[1].datatype == "character varying(20)"
    both = cat.tables["co-writePaper"]
    assert both.primary_key == ("Co-author", "Paper") and both.role == "join_table"
    assert [fk.ref_table for fk in both.foreign_keys] == ["people", "papers"] and both.foreign_keys[0].ref_columns == ("id",)
    assert cat.tables["ONLY_X"].primary_key == ("a",)
    assert search_path(DUMP) == "mini" and search_path("SET search_path = public, pg_catalog;") is None


def test_roles():
    col = lambda *n: tuple(map(Column, n))
    fk = lambda c, t, r="id": ForeignKey((c,), t, (r,))
    assert TableMeta("authors", col("id"), ("id",), (fk("id", "members"),)).role == "subtype_table"
    assert TableMeta("pa", col("aid", "pid"), ("aid", "pid"), (fk("aid", "a"), fk("pid", "p"))).role == "join_table"
    assert TableMeta("cm", col("conference", "member"), ("conference", "member"), (fk("conference", "c"),)).role == "join_table"
    assert TableMeta("t", col("id", "x"), ("id",)).role == "entity_table"


def test_copy_blocks(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP)
    cat = parse_ddl(DUMP)
    for rows in (copy_blocks.read_copy(spark, str(path)), copy_blocks.read_copy_anywhere(spark, str(path))):
        frames = copy_blocks.frames(rows, cat)
        assert {tuple(r) for r in frames["people"].collect()} == {("1", "Ada", "ada@example.org"), ("2", "Grace", None)}
        assert [tuple(r) for r in frames["co-writePaper"].collect()] == [("1", "947")]
    files.write_copy(frames["people"], cat, "people", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\tAda\tada@example.org", "2\tGrace\t\\N"]


def test_qpair():
    text = "id = Q01\n  name= all people\ncategories = attrib, x\nsql = SELECT email \\n\\\n  FROM people\nsparql=PREFIX : <http://ex#> SELECT ?e\n  WHERE { ?p :email ?e . FILTER(?e != \"a\") }\nnote = cut here\ndisabled = Yes\n"
    q = qpair.parse_qpair(text)
    assert q.id == "Q01" and q.name == "all people" and q.categories == ("attrib", "x") and q.disabled
    assert q.sql == "SELECT email FROM people"
    assert q.sparql.endswith('FILTER(?e != "a") }')


def test_turtle(spark, tmp_path):
    text = '@prefix ex: <http://ex#> . ex:a a ex:B ; ex:p "x\\"y"@en, "1"^^ex:int ; ex:q _:b1 . <http://ex#c> ex:p ex:a .'
    got = turtle.parse_turtle(text)
    assert ("http://ex#a", "http://ex#p", 'x"y', True) in got and ("http://ex#a", "http://ex#q", "_:b1", False) in got and len(got) == 5
    with pytest.raises(turtle.TurtleError):
        turtle.parse_turtle("ex:a ex:b ex:c .")
    frame = turtle.triples_frame(spark, [("urn:a", "urn:p", 'quote " back \\ line\nend\t', True), ("urn:a", "urn:q", "urn:b", False)])
    files.write_n_triples(frame, str(tmp_path / "nt"))
    back = turtle.read_n_triples(spark, str(tmp_path / "nt"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in frame.collect()}


def test_files(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    files.write_csv(df, str(tmp_path / "c"), ["b", "z", "a"])
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["b", "z", "a"] and back.filter(F.col("a") == "2").first()["b"] == "x"
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a int, b string").count() == 2
    files.register_scenario(spark, {"few": df})
    assert [tuple(r) for r in files.run_sql(spark, "SELECT sum(a) AS s FROM few").collect()] == [("3",)]


def test_catalog_cycle():
    col = (Column("id"),)
    cat = Catalog.of([TableMeta("a", col, ("id",), (ForeignKey(("id",), "b", ("id",)),)), TableMeta("b", col, ("id",), (ForeignKey(("id",), "a", ("id",)),))])
    assert [t for t, _ in cat.identity_chain("a")] == ["a", "b"]
