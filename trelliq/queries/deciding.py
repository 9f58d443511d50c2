"""ret_*: decisions of several passes, answers to requests, artifacts, and records enriched by source facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import star_catalog
from ..operators import decisions
from ..plans import materialize
from .base import read, register
from .corpus import ask

REGISTRY: dict = {}
_CANDIDATES = "SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS rank FROM (SELECT DISTINCT o_custkey AS source, o_orderpriority AS target FROM orders) q"
_WORDS = "CASE ({}) % 8 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' WHEN 5 THEN 'No_Match' WHEN 6 THEN 'unheard of' END"


def _said(n: int) -> str:
    """What the n-th provider says of every customer."""
    return f"SELECT c_custkey AS source, {_WORDS.format(f'c_custkey * {2 * n + 1} + {n}')} AS target, CAST(c_custkey % (5 + {n}) AS DOUBLE) / 10 AS confidence FROM customer"


def _decided(n: int) -> str:
    """The same as a recorded decision: none unless offered."""
    return f"SELECT s.source, c.target, CASE WHEN c.target IS NULL THEN 0.0 ELSE s.confidence END AS confidence, c.rank FROM ({_said(n)}) s LEFT JOIN ({_CANDIDATES}) c ON c.source = s.source AND c.target = s.target WHERE s.source IN (SELECT o_custkey FROM orders)"


def _parts(spark, d):
    return ask(spark, d, _CANDIDATES), [decisions.Recorded(ask(spark, d, _said(n))) for n in range(3)]


def _rounded(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@register(
    REGISTRY,
    "ret_reviewed",
    f"SELECT source, CASE WHEN m IS NULL THEN c ELSE m END AS target, round(CASE WHEN m IS NULL THEN cc ELSE mc END, 6)::DOUBLE AS confidence FROM (SELECT a.source, CASE WHEN a.target IS NOT NULL THEN b.target END AS m, b.confidence AS mc, c.target AS c, c.confidence AS cc FROM ({_decided(0)}) a JOIN ({_decided(1)}) b USING (source) JOIN ({_decided(2)}) c USING (source))",
)
def _(spark, d):
    c, p = _parts(spark, d)
    return _rounded(decisions.Reviewed(*p).decide(c))


@register(
    REGISTRY,
    "ret_voted",
    f"SELECT source, target, CASE WHEN target IS NULL THEN 0 ELSE round(c, 6) END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, round(c, 9) DESC, coalesce(rank, 1073741824), target IS NULL, target) AS r FROM (SELECT source, target, count(*) AS n, avg(confidence) AS c, any_value(rank) AS rank FROM ({' UNION ALL '.join(_decided(n) for n in range(3))}) GROUP BY source, target)) WHERE r = 1",
)
def _(spark, d):
    c, p = _parts(spark, d)
    return _rounded(decisions.Voted(*p).decide(c))


_LISTS = "SELECT o_custkey AS source_id, o_orderpriority AS target, CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 3 END AS reasons FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderpriority"


@register(
    REGISTRY,
    "ret_shortlisted",
    f"SELECT source, target, coalesce(round(confidence, 6), 0)::DOUBLE AS confidence FROM (SELECT DISTINCT o_custkey AS source FROM orders) LEFT JOIN (SELECT s.source, l.target, CASE WHEN l.target IS NULL THEN 0 ELSE s.confidence END AS confidence FROM ({_said(0)}) s LEFT JOIN ({_LISTS}) l ON l.source_id = s.source AND l.target = s.target WHERE s.source IN (SELECT source_id FROM ({_LISTS}) GROUP BY 1 HAVING count(*) <= 3 AND max(reasons) = 3)) USING (source)",
)
def _(spark, d):
    c, p = _parts(spark, d)
    lists = ask(spark, d, _LISTS).groupBy("source_id").agg(F.collect_list(F.struct("target", F.array_repeat(F.lit("why"), F.col("reasons")).alias("reasons"))).alias("items"))
    return _rounded(decisions.Shortlisted(lists, p[0]).decide(c))


_ANSWERS = f"SELECT source, CASE WHEN source % 9 = 0 THEN 2 ELSE 1 END AS asked, CASE WHEN source % 11 = 0 THEN source + 1 ELSE source END AS said_source, target, confidence, source % 13 = 0 AS failed FROM ({_said(1)}) s"


@register(
    REGISTRY,
    "ret_answers",
    f"SELECT source, CASE error_type WHEN '' THEN CASE WHEN t IS NULL THEN 'no_match' ELSE 'selected' END WHEN 'api_error' THEN 'api_error' ELSE 'invalid' END AS decision, error_type, CASE WHEN error_type = '' THEN t END AS predicted, CASE WHEN error_type = '' THEN rank END AS candidate_rank, CASE WHEN error_type = '' THEN round(confidence, 6) ELSE 0 END::DOUBLE AS confidence FROM "
    f"(SELECT a.*, CASE WHEN a.target = 'No_Match' THEN NULL ELSE a.target END AS t, rank, CASE WHEN failed THEN 'api_error' WHEN asked <> 1 OR said_source <> a.source THEN 'missing_source_id' WHEN a.target IS NOT NULL AND a.target <> 'No_Match' AND rank IS NULL THEN 'invalid_target_uri' ELSE '' END AS error_type FROM ({_ANSWERS}) a LEFT JOIN ({_CANDIDATES}) c ON c.source = a.source AND c.target = a.target)",
)
def _(spark, d):
    out = decisions.judged_answers(ask(spark, d, _ANSWERS), ask(spark, d, _CANDIDATES))
    return _rounded(out).withColumn("candidate_rank", F.col("candidate_rank").cast("long"))


_RECORDS = "SELECT o_orderpriority AS target, min(o_orderkey) AS id, max(o_orderstatus) AS label FROM orders GROUP BY o_orderpriority"


@register(REGISTRY, "ret_artifact", f"SELECT target, source, rank, id, label FROM ({_CANDIDATES}) JOIN ({_RECORDS}) USING (target) WHERE rank <= 3")
def _(spark, d):
    artifact = ask(spark, d, _CANDIDATES).withColumn("provider", F.lit("p")).withColumn("model", F.lit("m"))
    sources = artifact.select("source").distinct()
    return decisions.load_artifact(artifact, sources, ask(spark, d, _RECORDS), 3, provider="p", model="m").withColumn("rank", F.col("rank").cast("long"))


_FIRST = "(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {v} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))"
_BASE = "urn:trelliq:direct:"


def _line(t: str, c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"SELECT '{_BASE}{t}#{c}' AS iri, (SELECT count({c}) FROM {t}) AS n, {_FIRST.format(v=v, t=t, c=c)} AS samples"


@register(REGISTRY, "ret_enriched", " UNION ALL ".join([*[_line(t, c) for t, cs in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name")), ("customer", ("c_mktsegment",))) for c in cs], *[f"SELECT '{_BASE}{t}', (SELECT count(*) FROM {t}), ''" for t in ("nation", "region", "customer")]]))
def _(spark, d):
    facts = materialize.direct_mapping(star_catalog(), read(spark, d, "nation", "region", "customer"))
    some = materialize.evidence(facts)
    wanted = [f"{_BASE}{x}" for x in ("nation#n_nationkey", "nation#n_name", "nation#n_regionkey", "region#r_regionkey", "region#r_name", "customer#c_mktsegment", "nation", "region", "customer")]
    return some.filter(F.col("iri").isin(*wanted))
