"""sparql_*: graph patterns over the star facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.graphquery import graph_query
from .base import STAR_SQL, iri, register, star_planner, star_triples

REGISTRY: dict = {}
PREFIX = "PREFIX : <urn:tpch:> "
C, N, R, O = iri("customer", "c_custkey"), iri("nation", "n_nationkey"), iri("region", "r_regionkey"), iri("orders", "o_orderkey")  # noqa: E741


def ask(name: str, query: str, sql: str) -> None:
    @register(REGISTRY, name, sql)
    def _(spark, d):
        return graph_query(star_planner(spark, d), PREFIX + query)


ask("sparql_bgp2", "SELECT ?c ?n WHERE { ?c :name ?n . ?c :segment \"BUILDING\" }", f"SELECT {C} AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("sparql_bgp3", "SELECT ?c ?nn { ?x :inNation ?n ; :name ?c . ?n :name ?nn }", "SELECT c_name AS c, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
ask("sparql_star", "SELECT ?n ?s ?k WHERE { ?x a :Customer ; :name ?n ; :segment ?s ; :inNation ?k }", f"SELECT c_name AS n, c_mktsegment AS s, {iri('nation', 'c_nationkey')} AS k FROM customer")
ask("sparql_count", "SELECT (COUNT(?c) AS ?n) (COUNT(DISTINCT ?k) AS ?k_n) WHERE { ?c a :Customer . ?c :inNation ?k }", "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS k_n FROM customer")
ask("sparql_group", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?c :segment ?s } GROUP BY ?s", "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1")
ask("sparql_distinct", "SELECT DISTINCT ?s WHERE { ?c :segment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer")
ask("sparql_order_limit", "SELECT ?n WHERE { ?c a :Customer ; :name ?n } ORDER BY DESC(?n) LIMIT 10 OFFSET 3", "SELECT c_name AS n FROM customer ORDER BY c_name DESC LIMIT 10 OFFSET 3")
ask("sparql_union", "SELECT ?x ?n WHERE { { ?x a :Nation ; :name ?n } UNION { ?x a :Region ; :name ?n } }", f"SELECT {N} AS x, n_name AS n FROM nation UNION ALL SELECT {R}, r_name FROM region")
ask("sparql_minus", "SELECT ?c WHERE { ?c a :Customer MINUS { ?o :placedBy ?c ; :status \"P\" } }", f"SELECT {C} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
ask("sparql_optional", "SELECT ?c ?o WHERE { ?c a :Customer OPTIONAL { ?o :placedBy ?c ; :status \"P\" } }", f"SELECT {C} AS c, {O} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
ask("sparql_filter", "SELECT ?c ?n WHERE { ?c a :Customer ; :name ?n ; :segment ?s FILTER ((regex(?n, \"1$\") || ?s = \"MACHINERY\") && ?s != \"BUILDING\") }", f"SELECT {C} AS c, c_name AS n FROM customer WHERE (regexp_matches(c_name, '1$') OR c_mktsegment = 'MACHINERY') AND c_mktsegment <> 'BUILDING'")
ask("sparql_path_plus", "SELECT ?a ?b WHERE { ?a :inRegion+ ?b }", f"SELECT {N} AS a, {iri('region', 'n_regionkey')} AS b FROM nation")

ask("sparql_path_sequence", "SELECT ?c ?r WHERE { ?c a :Customer ; :inNation/:inRegion/:name ?r }", f"SELECT {C} AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
ask("sparql_path_inverse", "SELECT ?r ?c WHERE { ?r a :Region ; ^:inRegion/^:inNation ?c }", f"SELECT {R} AS r, {C} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT {R}, {iri('supplier', 's_suppkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
ask("sparql_path_alternative", "SELECT ?x ?p WHERE { ?x a :Nation ; :inRegion|:name ?p }", f"SELECT {N} AS x, n_name AS p FROM nation UNION ALL SELECT {N}, {iri('region', 'n_regionkey')} FROM nation")
ask("sparql_path_star", "SELECT ?n ?x WHERE { ?n a :Nation ; :inRegion* ?x }", f"SELECT {N} AS n, {N} AS x FROM nation UNION ALL SELECT {N}, {iri('region', 'n_regionkey')} FROM nation")
ask("sparql_path_closure", "SELECT ?c ?x WHERE { ?c a :Customer ; (:inNation|:inRegion)+ ?x }", f"SELECT {C} AS c, {N} AS x FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {C}, {R} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
ask("sparql_path_optional", "SELECT ?n ?x WHERE { ?n a :Nation ; :inRegion? ?x }", f"SELECT {N} AS n, {N} AS x FROM nation UNION ALL SELECT {N}, {iri('region', 'n_regionkey')} FROM nation")
ask("sparql_having", "SELECT ?k (COUNT(?c) AS ?n) WHERE { ?c a :Customer ; :inNation ?k } GROUP BY ?k HAVING (COUNT(DISTINCT ?c) > 5) (?n < 70)", f"SELECT {iri('nation', 'c_nationkey')} AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 5 AND count(*) < 70")
ask("sparql_avg_distinct", "SELECT (AVG(DISTINCT ?k) AS ?m) WHERE { ?x :name ?n . ?x a :Nation . ?x :inRegion ?r . ?r :name ?k }", "SELECT avg(DISTINCT try_cast(r_name AS DOUBLE)) AS m FROM region")


@register(REGISTRY, "sparql_scan", f"SELECT p, count(*) AS n, count(DISTINCT o) AS objects FROM (SELECT DISTINCT * FROM ({STAR_SQL})) GROUP BY p")
def _(spark, d):
    return star_triples(spark, d).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("objects"))
