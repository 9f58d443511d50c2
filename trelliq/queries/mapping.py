"""map_*: rules to facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalog, Column, ForeignKey, TableMeta, star_catalog
from ..functions import text
from ..plans import compiler, materialize, program
from ..plans.materialize import TYPE, RulePlanner
from .base import NS, STAR_RULES, STAR_SQL, cls, data, fact, filtered, iri, link, planner, read, register, table
from .corpus import ask

REGISTRY: dict = {}
C, N, O = iri("customer", "c_custkey"), iri("nation", "n_nationkey"), iri("orders", "o_orderkey")  # noqa: E741
FACT = ("s", "p", "o", "is_literal")


@register(REGISTRY, "map_class", fact(C, TYPE, f"'{NS}Customer'", False, "customer"))
def _(spark, d):
    return planner(spark, d, [cls("customer", "Customer")]).triples()


@register(REGISTRY, "map_data", fact(C, NS + "segment", "c_mktsegment", True, "customer WHERE c_mktsegment <> 'BUILDING' AND c_mktsegment <> ''"))
def _(spark, d):
    frame = table(spark, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return planner(spark, d, [data("customer", "c_mktsegment", "segment")], {"customer": frame}).triples()


@register(REGISTRY, "map_data_fk_subject", fact(iri("customer", "o_custkey"), NS + "orderPriority", "o_orderpriority", True, "orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"))
def _(spark, d):
    rule = data("orders", "o_orderpriority", "orderPriority", subject_table="customer", subject_columns=("o_custkey",))
    return planner(spark, d, [rule], {"customer": table(spark, d, "customer").filter("c_acctbal < 0")}).triples()


@register(REGISTRY, "map_object_fk", fact(C, NS + "inNation", iri("nation", "c_nationkey"), False, "customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)"))
def _(spark, d):
    return planner(spark, d, [link("customer", "c_nationkey", "nation", "inNation")]).triples()


@register(REGISTRY, "map_object_inverse", fact(iri("customer", "o_custkey"), NS + "placed", O, False, "orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"))
def _(spark, d):
    rule = link("orders", "", "customer", "placed", subject_table="customer", subject_columns=("o_custkey",), object_table="orders", object_columns=("o_orderkey",))
    return planner(spark, d, [rule]).triples()


_ASSOC = fact(iri("orders", "l_orderkey"), NS + "containsPart", iri("part", "l_partkey"), False, "lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)")
ASSOC = link("lineitem", "", "part", "containsPart", subject_table="orders", subject_columns=("l_orderkey",), object_table="part", object_columns=("l_partkey",))


@register(REGISTRY, "map_object_assoc", _ASSOC)
def _(spark, d):
    frames = {"orders": table(spark, d, "orders").filter("o_orderstatus = 'F'"), "part": table(spark, d, "part").filter("p_size < 25")}
    return planner(spark, d, [ASSOC], frames).triples()


@register(REGISTRY, "map_filter_truthy", fact(iri("documents", "doc_id"), TYPE, f"'{NS}Toxic'", False, "labels WHERE lower(trim(coalesce(CAST(toxic AS VARCHAR), 'None'))) IN ('1','t','true','yes','y')"))
def _(spark, d):
    return planner(spark, d, [cls("labels", "Toxic", row_filter=filtered("toxic", truthy=True))]).triples()


@register(REGISTRY, "map_filter_equals", fact(iri("events", "event_id"), TYPE, f"'{NS}Click'", False, "events WHERE lower(trim(event_type)) = 'click'"))
def _(spark, d):
    return planner(spark, d, [cls("events", "Click", row_filter=filtered("event_type", equals=" CLICK "))]).triples()


@register(REGISTRY, "map_instance_uri", f"SELECT conv_id, turn, {iri('conversations', 'conv_id', 'turn')} AS iri FROM conversations")
def _(spark, d):
    frame = table(spark, d, "conversations")
    p = RulePlanner("tpch", star_catalog(), {"conversations": frame}, [])
    row = {c: F.col(c).cast("string") for c in ("conv_id", "turn")}
    return frame.select("conv_id", "turn", p.iri("conversations", row, ("conv_id", "turn")).alias("iri"))


@register(REGISTRY, "map_canonical_uri", f"SELECT doc_id, {iri('documents', 'doc_id')} AS iri FROM labels")
def _(spark, d):
    frame = table(spark, d, "labels")
    p = RulePlanner("tpch", star_catalog(), {"labels": frame}, [])
    return frame.select("doc_id", p.canonical_iri("labels", {"doc_id": F.col("doc_id").cast("string")}).alias("iri"))


@register(REGISTRY, "map_safe_fragment", "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '_'), ''), 'id') AS fragment FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_fragment(F.col("url")).alias("fragment"))


_UNESCAPE = r"replace(replace(replace(replace(replace(props, '@', '\n'), '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), '\\', '\')".replace("@", '"')


@register(REGISTRY, "map_literal_unescape", f"SELECT event_id, {_UNESCAPE} AS literal FROM events")
def _(spark, d):
    marked = F.replace("props", F.lit('"'), F.lit(r"\n"))
    return table(spark, d, "events").select("event_id", text.unescape(marked).alias("literal"))


@register(REGISTRY, "map_uri_parts", "SELECT page_id, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#([^#]*)$', 1) ELSE regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) END AS local_name, CASE WHEN contains(url, '#') THEN regexp_extract(url, '^([^#]*#)', 1) ELSE regexp_replace(url, '[^/]*$', '') END AS namespace FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.local_name(F.col("url")).alias("local_name"), text.namespace(F.col("url")).alias("namespace"))


_TRAP = link("nation", "n_regionkey", "nation", "sameRegion", target_columns=("n_regionkey",))


@register(REGISTRY, "map_row_exists_trap", "SELECT 'primary_key_positional' AS existence, count(*) AS n FROM few WHERE n_regionkey IN (SELECT n_nationkey FROM few) UNION ALL SELECT 'target_columns', count(*) FROM few WHERE n_regionkey IN (SELECT n_regionkey FROM few)".replace("few", "(SELECT * FROM nation WHERE n_nationkey > 3)"))
def _(spark, d):
    few = {"nation": table(spark, d, "nation").filter("n_nationkey > 3")}
    plans = [planner(spark, d, [_TRAP], few, existence=e).triples().agg(F.count("*").alias("n")).select(F.lit(e).alias("existence"), "n") for e in ("primary_key_positional", "target_columns")]
    return plans[0].unionByName(plans[1])


@register(
    REGISTRY,
    "map_rule_stats",
    "SELECT 'class:0' AS rule_id, CASE WHEN event_type = 'click' THEN 'emitted' ELSE 'row_filter_rejected' END AS outcome, count(*) AS n FROM events GROUP BY ALL "
    "UNION ALL SELECT 'data:0', CASE WHEN c_mktsegment = 'BUILDING' THEN 'empty_source_value' ELSE 'emitted' END, count(*) FROM (SELECT c_mktsegment FROM customer) GROUP BY ALL "
    "UNION ALL SELECT 'object:0', CASE WHEN o_orderstatus = 'P' THEN 'missing_target_key' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'emitted' ELSE 'missing_target_row' END, count(*) FROM orders GROUP BY ALL",
)
def _(spark, d):
    everyone = table(spark, d, "customer")
    poor = everyone.filter("c_acctbal < 0")
    orders = table(spark, d, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS STRING) END"))
    segments = everyone.withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    first = planner(spark, d, [cls("events", "Click", row_filter=filtered("event_type", equals="click")), data("customer", "c_mktsegment", "segment")], {"customer": segments})
    second = planner(spark, d, [link("orders", "o_custkey", "customer", "placedBy")], {"orders": orders, "customer": poor})
    return first.stats().unionByName(second.stats())


@register(REGISTRY, "map_graph_set", f"SELECT DISTINCT s, p, o, is_literal FROM ({STAR_SQL})")
def _(spark, d):
    return planner(spark, d, STAR_RULES).graph()


@register(REGISTRY, "map_assoc_set", f"SELECT DISTINCT s, p, o, is_literal FROM ({_ASSOC})")
def _(spark, d):
    frames = {"orders": table(spark, d, "orders").filter("o_orderstatus = 'F'"), "part": table(spark, d, "part").filter("p_size < 25")}
    return planner(spark, d, [ASSOC], frames).graph()


@register(REGISTRY, "map_ntriples", f"SELECT DISTINCT '<' || s || '> <' || p || '> ' || CASE WHEN is_literal THEN '\"' || replace(replace(o, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE '<' || o || '>' END || ' .' AS line FROM ({STAR_SQL})")
def _(spark, d):
    return materialize.n_triples(planner(spark, d, STAR_RULES).graph())


@register(REGISTRY, "map_program_subset", f"SELECT s, p, o, is_literal FROM ({STAR_SQL}) WHERE p = '{TYPE}'")
def _(spark, d):
    code = "def materialize(context):\n    for rule in all_rules('class'):\n        for row in rows(rule):\n            emit_type(row, rule)\n"
    return program.run(planner(spark, d, STAR_RULES), code)


@register(
    REGISTRY,
    "map_direct_counts",
    " UNION ALL ".join(
        [f"SELECT '{TYPE}' AS iri, 'predicate' AS role, sum(n)::BIGINT AS triples FROM (SELECT count(*) n FROM nation UNION ALL SELECT count(*) FROM region)"]
        + [f"SELECT 'urn:trelliq:direct:{t}', 'class', count(*) FROM {t}" for t in ("nation", "region")]
        + [f"SELECT 'urn:trelliq:direct:{t}#{c}', 'predicate', count(nullif(CAST({c} AS VARCHAR), '')) FROM {t}" for t, c in (("nation", "n_nationkey"), ("nation", "n_name"), ("nation", "n_regionkey"), ("region", "r_regionkey"), ("region", "r_name"))]
        + ["SELECT 'urn:trelliq:direct:nation#ref-n_regionkey', 'predicate', count(*) FROM nation"]
    ),
)
def _(spark, d):
    facts = materialize.direct_mapping(star_catalog(), read(spark, d, "nation", "region"))
    return materialize.graph_counts(facts).select("iri", "role", "triples")


#: Matches from which rules are compiled: source, target, kind of target, domain and range.
MATCHES = [
    compiler.Match("source-class:customer", NS + "Customer"),
    compiler.Match("source-class:nation", NS + "Nation"),
    compiler.Match("source-data:customer.c_name", NS + "name", domain=(NS + "Customer",)),
    compiler.Match("source-data:nation.n_name", NS + "nationName", domain=(NS + "Nation",)),
    compiler.Match("source-object:customer.c_nationkey", NS + "inNation", domain=(NS + "Customer",), range=(NS + "Nation",)),
    compiler.Match("source-data:customer.c_acctbal", None),
]


@register(
    REGISTRY,
    "map_rules_end_to_end",
    " UNION ".join(
        [
            fact(C, TYPE, f"'{NS}Customer'", False, "customer"),
            fact(N, TYPE, f"'{NS}Nation'", False, "nation"),
            fact(C, NS + "name", "c_name", True, "customer"),
            fact(N, NS + "nationName", "n_name", True, "nation"),
            fact(C, NS + "inNation", iri("nation", "c_nationkey"), False, "customer"),
        ]
    ),
)
def _(spark, d):
    return planner(spark, d, compiler.compile_rules(MATCHES, star_catalog())).graph()


def ontology(spark, d) -> str:
    """Turtle of an ontology: a class for each nation, below its region's, and a property of each from the one to the other."""
    lines = ["@prefix : <urn:tpch:> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ."]
    pairs = ask(spark, d, "SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey").collect()  # as many as there are nations
    for name in sorted({p.r for p in pairs}):
        lines.append(f':{name.replace(" ", "_")} a owl:Class ; rdfs:label "{name}" .')
    for p in pairs:
        n, r = (x.replace(" ", "_") for x in (p.n, p.r))
        lines.append(f':{n} a owl:Class ; rdfs:subClassOf :{r} ; rdfs:comment "nation {p.k}" .')
        kind, extra = ("owl:ObjectProperty", "") if p.k % 3 == 0 else ("owl:DatatypeProperty", "") if p.k % 3 == 1 else ("owl:DatatypeProperty", "x")
        lines.append(f":has{n} a {kind} ; rdfs:domain :{r}{', :Other' if extra else ''}" + (f" ; rdfs:range :{n}" if p.k % 3 != 1 else "") + " .")
    return "\n".join(lines)


_U = "'urn:tpch:' || replace({}, ' ', '_')"
_PAIR = "(SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"


@register(
    REGISTRY,
    "map_ontology_records",
    f"SELECT 'class' AS kind, {_U.format('r')} AS uri, replace(r, ' ', '_') AS local_name, r AS label, '' AS comment, '' AS domain, '' AS range, '' AS parents FROM (SELECT DISTINCT r FROM {_PAIR}) UNION ALL SELECT 'class', {_U.format('n')}, replace(n, ' ', '_'), '', 'nation ' || k, '', '', {_U.format('r')} FROM {_PAIR} "
    f"UNION ALL SELECT CASE WHEN k % 3 = 1 THEN 'data_property' ELSE 'object_property' END, 'urn:tpch:has' || replace(n, ' ', '_'), 'has' || replace(n, ' ', '_'), '', '', CASE WHEN k % 3 <> 2 THEN {_U.format('r')} ELSE array_to_string(list_sort([{_U.format('r')}, 'urn:tpch:Other']), ',') END, CASE WHEN k % 3 = 1 THEN '' ELSE {_U.format('n')} END, '' FROM {_PAIR} "
    "UNION ALL SELECT 'data_property', 'http://www.w3.org/2000/01/rdf-schema#' || x, x, '', '', '', '', '' FROM (VALUES ('label'), ('comment')) v(x)",
)
def _(spark, d):
    from ..sources.turtle import ontology_records, parse_turtle, triples_frame

    found = ontology_records(triples_frame(spark, parse_turtle(ontology(spark, d))))
    return found.withColumns({c: F.array_join(c, ",") for c in ("domain", "range", "parents")}).select("kind", "uri", "local_name", "label", "comment", "domain", "range", "parents")


_WORKED = "SELECT CASE WHEN event_type = 'click' THEN NULL ELSE 'row_filter_rejected' END AS reason, CAST(event_id AS VARCHAR) AS key FROM events"


@register(
    REGISTRY,
    "map_rule_summary",
    " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, '{i.split(':')[0]}' AS kind, count(*) AS reachable_rows, count(*) AS helper_calls, count(*) FILTER (reason IS NULL) AS emitted, coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM ({q}) WHERE reason IS NOT NULL GROUP BY 1)), '') AS failures, coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT key FROM ({q}) WHERE reason IS NOT NULL ORDER BY key LIMIT 3)), '') AS samples FROM ({q})"
        for i, q in (
            ("class:0", _WORKED),
            ("data:0", "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'empty_source_value' END AS reason, CAST(c_custkey AS VARCHAR) AS key FROM customer"),
            ("object:0", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'missing_target_key' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'missing_target_row' END AS reason, CAST(o_orderkey AS VARCHAR) AS key FROM orders"),
        )
    ),
)
def _(spark, d):
    everyone = table(spark, d, "customer")
    orders = table(spark, d, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS STRING) END"))
    segments = everyone.withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    first = planner(spark, d, [cls("events", "Click", row_filter=filtered("event_type", equals="click")), data("customer", "c_mktsegment", "segment")], {"customer": segments})
    second = planner(spark, d, [link("orders", "o_custkey", "customer", "placedBy")], {"orders": orders, "customer": everyone.filter("c_acctbal < 0")})
    return first.rule_summary().unionByName(second.rule_summary())


def _chain_catalog() -> Catalog:
    col = lambda *n: tuple(map(Column, n))
    return Catalog.of([
        TableMeta("customer", col("c_custkey", "c_name"), ("c_custkey",)),
        TableMeta("buyer", col("b_key"), ("b_key",), (ForeignKey(("b_key",), "customer", ("c_custkey",)),)),
        TableMeta("fan", col("f_key", "f_order"), ("f_key",), (ForeignKey(("f_key",), "buyer", ("b_key",)),)),
    ])


@register(REGISTRY, "map_identity_chain", f"SELECT DISTINCT {iri('customer', 'o_custkey')} AS s, '{TYPE}' AS p, '{NS}Fan' AS o, FALSE AS is_literal FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, d):
    fans = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("f_key"), F.col("o_orderkey").alias("f_order"))
    return RulePlanner("tpch", _chain_catalog(), {"fan": fans}, [cls("fan", "Fan")]).graph()
