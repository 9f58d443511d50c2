"""rep_*: ledgers and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markdown
from ..operators import reporting as ops
from .base import register, table
from .corpus import ask

REGISTRY: dict = {}


#: Scores of scenarios: ours for most of them, a baseline's for some.
_OURS = "SELECT 's' || CAST(c_custkey AS STRING) AS scenario, c_custkey % 89 / 100.0 AS f1, c_custkey % 3 AS invalid FROM customer WHERE c_custkey % 10 <> 0"
_BASE = "SELECT 's' || CAST(c_custkey AS STRING) AS scenario, c_custkey % 83 / 100.0 AS f1, c_custkey % 4 AS invalid FROM customer WHERE c_custkey % 13 <> 0"


@register(
    REGISTRY,
    "rep_compare",
    f"SELECT scenario, round(f1, 6)::DOUBLE AS f1, round(baseline_f1, 6)::DOUBLE AS baseline_f1, round(f1 - baseline_f1, 6)::DOUBLE AS delta, CASE WHEN f1 IS NULL OR baseline_f1 IS NULL THEN 'pending' WHEN f1 - baseline_f1 > 0.015 THEN 'promote' WHEN f1 - baseline_f1 >= -0.015 AND invalid < baseline_invalid THEN 'promote' WHEN f1 - baseline_f1 >= -0.015 THEN 'keep' ELSE 'reject' END AS decision "
    f"FROM (SELECT 's' || c_custkey AS scenario FROM customer) LEFT JOIN ({_OURS}) USING (scenario) LEFT JOIN (SELECT scenario, f1 AS baseline_f1, invalid AS baseline_invalid FROM ({_BASE})) USING (scenario)",
)
def _(spark, d):
    everyone = ask(spark, d, "SELECT 's' || CAST(c_custkey AS STRING) AS scenario FROM customer")
    ours, base = (ask(spark, d, q).withColumn("f1", F.col("f1").cast("double")) for q in (_OURS, _BASE))
    return ops.compare(everyone, ours, base, margin=0.015).withColumns({c: F.round(c, 6) for c in ("f1", "baseline_f1", "delta")})


_PAIRS = "(SELECT o_orderkey % 4 AS a, o_custkey % 3 AS b, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END AS p, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END AS r, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Object' WHEN o_orderpriority = '5-LOW' THEN 'x, ref' ELSE 'attrib' END AS c FROM orders)"
_MODE = "CASE WHEN (a = 0 AND b = 0) OR (p = 1 AND r = 1) THEN NULL WHEN b = 0 AND a > 0 THEN 'zero_sparql_answers' WHEN a = 0 AND b > 0 THEN 'overgenerated_sparql_answers' WHEN r < 1 AND c IN ('Object', 'x, ref') THEN 'missing_or_wrong_link_path' WHEN r < 1 THEN 'missing_attribute_or_class' WHEN p < 1 AND b > a THEN 'overgenerated_sparql_answers' ELSE 'other' END"
_CAUSE = "CASE WHEN a > 0 AND b = 0 THEN 'missing RDF class/property/path' WHEN b > 0 AND a = 0 THEN 'false-positive RDF output' WHEN a = b THEN 'value or literal-normalization mismatch' ELSE 'partial coverage or extra rows' END"


@register(REGISTRY, "rep_failure_modes", f"SELECT {_MODE} AS category, {_CAUSE} AS cause, count(*) AS n FROM {_PAIRS} GROUP BY ALL")
def _(spark, d):
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    a, b = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    listed = F.when(F.col("o_orderpriority") == "1-URGENT", "Object").when(F.col("o_orderpriority") == "5-LOW", "x, ref").otherwise("attrib")
    mode = ops.failure_mode(a, b, F.when(s == "F", 1.0).otherwise(0.5), F.when(s == "O", 1.0).otherwise(0.5), listed)
    return o.groupBy(mode.alias("category"), ops.likely_cause(a, b).alias("cause")).agg(F.count("*").alias("n"))


#: A ledger: each customer's orders are a scenario's runs, in order of their keys.
_LEDGER = (
    "SELECT 's' || CAST(o_custkey AS STRING) AS scenario, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS iteration, o_orderkey % 100 / 100.0 AS f1, CAST(o_orderkey % 60 AS DOUBLE) AS seconds, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'blocked' ELSE 'pending' END AS status, "
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS cause, 'n' || CAST(o_orderkey % 4 AS STRING) AS note FROM orders"
)


@register(
    REGISTRY,
    "rep_benchmark_summary",
    f"WITH l AS ({_LEDGER}) SELECT scenario, runs, first_f1, last_f1, seconds, status, top_cause, round(last_f1 - first_f1, 6)::DOUBLE AS gain FROM (SELECT scenario, count(*) AS runs, min_by(f1, iteration)::DOUBLE AS first_f1, max_by(f1, iteration)::DOUBLE AS last_f1, sum(seconds) AS seconds, max_by(status, iteration) AS status FROM l GROUP BY 1) LEFT JOIN (SELECT scenario, cause AS top_cause FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY n DESC, cause DESC) AS r FROM (SELECT scenario, cause, count(*) AS n FROM l WHERE cause IS NOT NULL GROUP BY ALL)) WHERE r = 1) USING (scenario)",
)
def _(spark, d):
    return ops.summary(ask(spark, d, _LEDGER).withColumn("f1", F.col("f1").cast("double"))).drop("notes").withColumn("gain", F.round("gain", 6))


_NEW = "SELECT 's' || CAST(c_custkey * 2 AS STRING) AS scenario, c_custkey AS started, c_mktsegment AS model FROM customer"


@register(REGISTRY, "rep_ledger", f"WITH l AS ({_LEDGER}) SELECT scenario, iteration, NULL AS model FROM l UNION ALL SELECT n.scenario, coalesce(last, 0) + row_number() OVER (PARTITION BY n.scenario ORDER BY started), model FROM ({_NEW}) n LEFT JOIN (SELECT scenario, max(iteration) AS last FROM l GROUP BY 1) x ON x.scenario = n.scenario")
def _(spark, d):
    return ops.append_ledger(ask(spark, d, _LEDGER), ask(spark, d, _NEW)).select("scenario", F.col("iteration").cast("long"), "model")


_LINES = "SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'nothing here' ELSE 'matched ' || CAST(event_id AS STRING) || '/20000 seconds=' || CAST(user_id AS STRING) || '.5' END AS line FROM events"


@register(REGISTRY, "rep_event_stats", "SELECT max(event_id) AS matched, 20000 AS total, max(user_id) + 0.5::DOUBLE AS seconds FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    return ops.event_stats(ask(spark, d, _LINES)).select("matched", F.col("total").cast("int"), "seconds")


@register(REGISTRY, "rep_cost", "SELECT event_type, round(count(*) * 0.001 + 0.005 + count(DISTINCT user_id) * 0.000002, 6)::DOUBLE AS cost FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return e.select("event_type", F.round(ops.cost(F.col("n"), F.col("u")), 6).alias("cost"))


_ARMS = "SELECT 's' || CAST(o_custkey AS STRING) AS scenario, o_orderpriority AS arm, max(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 100 / 100.0 END) AS f1, CASE WHEN max(o_orderstatus) = 'P' THEN 'failed' ELSE 'ok' END AS status FROM orders GROUP BY o_custkey, o_orderpriority"
_PICKED = "SELECT 's' || CAST(o_custkey AS STRING) AS scenario, min(o_orderpriority) AS arm FROM orders GROUP BY o_custkey"


@register(REGISTRY, "rep_arm_comparison", f"SELECT scenario, arm, f1::DOUBLE AS f1, status FROM ({_ARMS}) UNION ALL SELECT scenario, 'portfolio_selected', f1, status FROM ({_ARMS}) WHERE (scenario, arm) IN (SELECT (scenario, arm) FROM ({_PICKED}))")
def _(spark, d):
    return ops.arm_comparison(ask(spark, d, _ARMS).withColumn("f1", F.col("f1").cast("double")), ask(spark, d, _PICKED))


@register(REGISTRY, "rep_matrix_pivot", 'SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = \'F\') AS "F", max(o_totalprice) FILTER (o_orderstatus = \'O\') AS "O", max(o_totalprice) FILTER (o_orderstatus = \'P\') AS "P" FROM orders GROUP BY 1')
def _(spark, d):
    return ops.pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@register(REGISTRY, "rep_markdown", f"SELECT '| ' || scenario || ' | ' || arm || ' | ' || coalesce(CAST(f1::DOUBLE AS VARCHAR), '') || ' | ' || status || ' |' AS line FROM ({_ARMS})")
def _(spark, d):
    return markdown.rows(ask(spark, d, _ARMS).withColumn("f1", F.col("f1").cast("double")), ["scenario", "arm", "f1", "status"])
