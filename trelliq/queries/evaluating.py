"""eval_*: scores of answers, rankings and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as ops
from ..plans.graphquery import graph_query
from ..sources import files
from .base import register, star_planner, table
from .corpus import ask
from .retrieving import BM25_RANKED, bm25_ranked

REGISTRY: dict = {}
PREFIX = "PREFIX : <urn:tpch:> "


@register(REGISTRY, "eval_sql_ref", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    return files.as_text(ask(spark, d, "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_acctbal < 0"))


@register(REGISTRY, "eval_sql_join", "SELECT n_name, CAST(count(*) AS VARCHAR) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    return files.as_text(ask(spark, d, "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"))


_PRF = """SELECT count(*) FILTER (side = 'a') AS n_answer, count(*) FILTER (side = 'b') AS n_reference, count(*) FILTER (side = 'a' AND hit) AS hit_answer, count(*) FILTER (side = 'b' AND hit) AS hit_reference FROM (
SELECT 'a' AS side, k IN (SELECT c_name FROM customer WHERE c_acctbal > 100) AS hit FROM (SELECT c_name AS k FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL
SELECT 'b', c_name IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING') FROM customer WHERE c_acctbal > 100)"""
_SCORES = "SELECT *, hit_answer / n_answer AS precision, hit_reference / n_reference AS recall"


@register(REGISTRY, "eval_prf", f"SELECT n_answer, n_reference, hit_answer, hit_reference, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM ({_SCORES} FROM ({_PRF}))")
def _(spark, d):
    answer = graph_query(star_planner(spark, d), PREFIX + 'SELECT ?n WHERE { ?c :segment "BUILDING" ; :name ?n }')
    reference = table(spark, d, "customer").filter("c_acctbal > 100").select("c_name")
    return ops.membership_scores(ops.render(answer), ops.render(reference)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register(REGISTRY, "eval_scenario_mean", f"SELECT round((f + 1.0) / 2, 6) AS f1 FROM (SELECT 2 * precision * recall / (precision + recall) AS f FROM ({_SCORES} FROM ({_PRF})))")
def _(spark, d):
    g = star_planner(spark, d)
    one = ops.membership_scores(ops.render(graph_query(g, PREFIX + 'SELECT ?n WHERE { ?c :segment "BUILDING" ; :name ?n }')), ops.render(table(spark, d, "customer").filter("c_acctbal > 100").select("c_name")))
    two = ops.membership_scores(ops.render(graph_query(g, PREFIX + "SELECT ?n WHERE { ?c a :Nation ; :name ?n }")), ops.render(table(spark, d, "nation").select("n_name")))
    return one.unionByName(two).agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("f1"))


_GOLD = "(SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, d):
    """Documents that hold a benchmark passage."""
    return ops.holders(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").select("item_id", "doc_id")


@register(REGISTRY, "eval_attach_gold", f"SELECT item_id, doc_id, rank, (item_id, doc_id) IN (SELECT (item_id, doc_id) FROM {_GOLD}) AS is_gold FROM {BM25_RANKED} WHERE rank <= 16")
def _(spark, d):
    g = gold(spark, d).withColumn("hit", F.lit(True))
    return bm25_ranked(spark, d).filter("rank <= 16").join(g, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.col("rank").cast("long"), F.coalesce("hit", F.lit(False)).alias("is_gold"))


_FIRST = f"(SELECT g.item_id, CASE WHEN min(r.rank) <= 20 THEN min(r.rank) END AS first_rank, min(r.rank) AS rank_anywhere, coalesce(1.0 / CASE WHEN min(r.rank) <= 20 THEN min(r.rank) END, 0)::DOUBLE AS reciprocal_rank, (SELECT count(*) FROM {BM25_RANKED} x WHERE x.item_id = g.item_id AND x.rank <= 20) AS candidate_count FROM {_GOLD} g LEFT JOIN {BM25_RANKED} r ON g.item_id = r.item_id AND g.doc_id = r.doc_id GROUP BY g.item_id)"
_FOUND = ", ".join(f"CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END AS found_at_{k}" for k in ops.K_VALUES)
_DETAILS = f"(SELECT *, {_FOUND} FROM {_FIRST})"


def details(spark, d):
    return ops.first_ranks(bm25_ranked(spark, d), gold(spark, d), "item_id", "doc_id")


@register(REGISTRY, "eval_first_rank", f"SELECT item_id, first_rank, rank_anywhere, round(reciprocal_rank, 6) AS reciprocal_rank, candidate_count, found_at_1, found_at_5, found_at_20 FROM {_DETAILS}")
def _(spark, d):
    return details(spark, d).select("item_id", "first_rank", "rank_anywhere", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "candidate_count", "found_at_1", "found_at_5", "found_at_20")


def metrics_sql(rel: str, by: str) -> str:
    names = "round(avg(reciprocal_rank), 6) AS mrr, round(avg(first_rank), 6) AS mean_rank_first_gold, round(avg(CASE WHEN candidate_count > 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS candidate_coverage, round(avg(CASE WHEN candidate_count = 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS zero_candidate_rate, count(*) AS n"
    return " UNION ALL ".join(f"SELECT {by}{', ' if by else ''}{k} AS k, round(avg(found_at_{k}), 6) AS recall_at_k, {names} FROM {rel}{' GROUP BY ' + str(by.count(',') + 1) if by and ' AS ' in by else ''}" for k in ops.K_VALUES)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("recall_at_k", "mrr", "mean_rank_first_gold", "candidate_coverage", "zero_candidate_rate")})


@register(REGISTRY, "eval_retrieval_metrics", metrics_sql(_DETAILS, ""))
def _(spark, d):
    return _rounded(ops.retrieval_metrics(details(spark, d), []))


_KINDED = f"(SELECT *, CASE WHEN item_id % 2 = 0 THEN 'class' ELSE 'data_property' END AS kind, 'role' || item_id % 3 AS role FROM {_DETAILS})"


def kinded(spark, d):
    return details(spark, d).withColumn("kind", F.when(F.col("item_id") % 2 == 0, "class").otherwise("data_property")).withColumn("role", F.concat(F.lit("role"), (F.col("item_id") % 3).cast("string")))


@register(REGISTRY, "eval_retrieval_rollup", metrics_sql(_KINDED, "kind AS kind") + " UNION ALL " + metrics_sql(_KINDED, "'all'").replace("'all', ", "'all' AS kind, "))
def _(spark, d):
    return _rounded(ops.retrieval_metrics(kinded(spark, d), ["kind"], "kind"))


@register(REGISTRY, "eval_by_role", metrics_sql(_KINDED, "role AS role"))
def _(spark, d):
    return _rounded(ops.retrieval_metrics(kinded(spark, d), ["role"]))


#: Sources whose gold lies elsewhere: for each item the documents of one in seven, whatever they rank.
_ELSEWHERE = "(SELECT item_id, doc_id FROM benchmark b JOIN documents d ON d.doc_id % 7 = b.item_id % 7 AND d.doc_id < 60)"
_ELSE_FIRST = _FIRST.replace(_GOLD, _ELSEWHERE)


@register(
    REGISTRY,
    "eval_failure_category",
    f"SELECT item_id, CASE WHEN candidate_count = 0 THEN 'zero_candidates' WHEN item_id % 5 = 0 THEN 'wrong_kind_filtering' WHEN rank_anywhere > 20 THEN 'correct_target_rank_too_low' WHEN gap <= 1e-12 THEN 'ambiguous_candidates' ELSE 'bm25_tokenization_failure' END AS category FROM {_ELSE_FIRST} f LEFT JOIN (SELECT item_id, abs(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) AS gap FROM {BM25_RANKED} WHERE rank <= 2 GROUP BY item_id) USING (item_id) WHERE first_rank IS NULL OR first_rank > 1",
)
def _(spark, d):
    far = ask(spark, d, "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON d.doc_id % 7 = b.item_id % 7 AND d.doc_id < 60")
    ranked = bm25_ranked(spark, d)
    rows = ops.first_ranks(ranked, far, "item_id", "doc_id").filter("first_rank is null or first_rank > 1").join(ops.top_gap(ranked, "item_id"), "item_id", "left")
    return rows.select("item_id", ops.failure_category("bm25", F.col("item_id") % 5 == 0, F.col("rank_anywhere"), F.col("candidate_count"), F.col("gap")).alias("category"))


_METHODS = "SELECT 's' || CAST(o_custkey % 200 AS STRING) AS scenario, o_orderpriority AS method, round(avg(CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE 1.0 END), 6) AS recall FROM orders GROUP BY o_custkey % 200, o_orderpriority"


@register(REGISTRY, "eval_best_method", f"SELECT scenario, method, recall, recall < 0.95 AS difficult FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY recall DESC, method) AS r FROM ({_METHODS})) WHERE r = 1")
def _(spark, d):
    return ops.best_methods(ask(spark, d, _METHODS).withColumn("recall", F.col("recall").cast("double")), ["scenario"], "method", "recall")


#: Labels scored as matches: quality is gold, toxic what was said; null where 0.
_MATCHED = "(SELECT CASE WHEN quality = 1 THEN 'good' END AS gold, CASE WHEN toxic = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE 'good' END END AS predicted, doc_id % 11 = 0 AS invalid, doc_id % 13 = 0 AS api_error, (doc_id % 10) / 10.0 AS confidence, 'm' || doc_id % 2 AS method FROM labels)"


def matched(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "labels").select(
        F.when(F.col("quality") == 1, "good").alias("gold"), F.when(F.col("toxic") == 0, F.when(i % 5 == 0, "bad").otherwise("good")).alias("predicted"), (i % 11 == 0).alias("invalid"), (i % 13 == 0).alias("api_error"), ((i % 10) / 10).alias("confidence"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("method"),
    )
    return rows.withColumn("correct", F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False)) & ~F.col("invalid") & ~F.col("api_error"))


_CORRECT = f"(SELECT *, coalesce(gold = predicted, FALSE) AND NOT invalid AND NOT api_error AS correct FROM {_MATCHED})"


@register(
    REGISTRY,
    "eval_matching_metrics",
    f"SELECT method, evaluated_sources, gold_mapped_sources, true_positives, false_positives, false_negatives, predicted_matches, predicted_nulls, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round((false_positives + false_negatives + bad) / evaluated_sources, 6) AS error_rate FROM (SELECT *, true_positives / (true_positives + false_positives) AS p, true_positives / gold_mapped_sources AS r, gold_mapped_sources - true_positives AS false_negatives FROM "
    f"(SELECT method, count(*) AS evaluated_sources, count(gold) AS gold_mapped_sources, count(*) FILTER (gold IS NOT NULL AND correct) AS true_positives, count(*) FILTER (gold IS NOT NULL AND predicted IS NOT NULL AND NOT correct AND NOT invalid AND NOT api_error) AS false_positives, count(*) FILTER (predicted IS NOT NULL AND NOT invalid AND NOT api_error) AS predicted_matches, count(*) FILTER (predicted IS NULL AND NOT invalid AND NOT api_error) AS predicted_nulls, count(*) FILTER (invalid OR api_error) AS bad FROM {_CORRECT} GROUP BY method))",
)
def _(spark, d):
    out = ops.matching_metrics(matched(spark, d), ["method"])
    keep = ["method", "evaluated_sources", "gold_mapped_sources", "true_positives", "false_positives", "false_negatives", "predicted_matches", "predicted_nulls", "precision", "recall", "f1", "error_rate"]
    return out.select(*keep).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "error_rate")})


@register(
    REGISTRY,
    "eval_matching_extras",
    f"SELECT method, count(*) FILTER (invalid) AS invalid_selections, count(*) FILTER (api_error) AS api_errors, round(avg(confidence), 6) AS avg_confidence, round(avg(candidate_rank), 6) AS avg_candidate_rank, round(sum(runtime_seconds), 6) AS runtime_seconds, count(*) FILTER (predicted IS NOT NULL AND NOT invalid AND NOT api_error) AS all_source_predicted_matches, count(*) FILTER (predicted IS NULL AND NOT invalid AND NOT api_error) AS all_source_predicted_nulls, count(*) FILTER (gold IS NULL) AS unlabeled_sources FROM (SELECT *, CASE WHEN confidence > 0.2 THEN CAST(confidence * 10 AS INT) END AS candidate_rank, confidence * 2 AS runtime_seconds FROM {_MATCHED}) GROUP BY method",
)
def _(spark, d):
    rows = matched(spark, d).withColumn("candidate_rank", F.when(F.col("confidence") > 0.2, F.round(F.col("confidence") * 10).cast("int"))).withColumn("runtime_seconds", F.col("confidence") * 2)
    keep = ["method", "invalid_selections", "api_errors", "avg_confidence", "avg_candidate_rank", "runtime_seconds", "all_source_predicted_matches", "all_source_predicted_nulls", "unlabeled_sources"]
    return ops.matching_metrics(rows, ["method"]).select(*keep).withColumns({c: F.round(c, 6) for c in ("avg_confidence", "avg_candidate_rank", "runtime_seconds")})


@register(
    REGISTRY,
    "eval_confusion",
    f"SELECT method, CASE WHEN api_error THEN 'api_error' WHEN invalid THEN 'invalid_selection' WHEN gold IS NOT NULL AND correct THEN 'selected_correct' WHEN gold IS NOT NULL AND predicted IS NOT NULL THEN 'selected_wrong' WHEN gold IS NOT NULL THEN 'null_when_gold_match' WHEN predicted IS NOT NULL THEN 'selected_when_gold_null' ELSE 'null_when_gold_null' END AS bucket, count(*) AS n FROM {_CORRECT} GROUP BY ALL",
)
def _(spark, d):
    return matched(spark, d).groupBy("method", ops.confusion_bucket().alias("bucket")).agg(F.count("*").alias("n"))


_VOTES = "(SELECT o_custkey, o_orderpriority AS predicted, count(*) AS votes, avg(o_totalprice / 1000000) AS conf FROM (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice FROM orders) GROUP BY ALL)"


@register(
    REGISTRY,
    "eval_self_consistency",
    f"SELECT o_custkey, CASE WHEN NOT (ties > 1 AND predicted IS NOT NULL AND conf < 0.2) THEN predicted END AS predicted, votes, ties > 1 AS tie, round(1 - votes / total, 6) AS disagreement FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, round(conf, 9) DESC, CASE WHEN predicted IS NULL THEN 1000000000 ELSE ascii(predicted) END, predicted IS NULL, predicted) AS r, sum(votes) OVER (PARTITION BY o_custkey) AS total, count(*) FILTER (votes = top) OVER (PARTITION BY o_custkey) AS ties FROM (SELECT *, max(votes) OVER (PARTITION BY o_custkey) AS top FROM {_VOTES})) WHERE r = 1",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    samples = orders.select("o_custkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("predicted"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    ranks = samples.filter("predicted is not null").select("o_custkey", "predicted", F.ascii("predicted").alias("rank")).distinct()
    return ops.majority_votes(samples, "o_custkey", ranks, 0.2).withColumn("disagreement", F.round("disagreement", 6))


_URIS = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN '<' || url || '>' WHEN 1 THEN 'URIRef(' || chr(39) || url || chr(39) || ')' WHEN 2 THEN 'ex:p' || CAST(page_id AS STRING) WHEN 3 THEN url WHEN 4 THEN 'unknown:e' WHEN 5 THEN '  ' END AS raw FROM pages"


@register(REGISTRY, "eval_normalize_uri", f"SELECT page_id, CASE page_id % 7 WHEN 0 THEN trim(url) WHEN 1 THEN url WHEN 2 THEN 'http://ex.org/p' || page_id WHEN 3 THEN trim(url) WHEN 4 THEN 'unknown:e' ELSE '' END AS uri FROM pages")
def _(spark, d):
    return ask(spark, d, _URIS).select("page_id", text.normalize_uri(F.col("raw"), {"ex": "http://ex.org/"}).alias("uri"))


#: What queries read and name: one for each order and part of it.
_SQL_USE = "SELECT 'q' || CAST(l_orderkey AS STRING) AS query_id, CASE l_linenumber % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'data' ELSE 'object' END AS kind, 'source:' || CAST(l_suppkey % 60 AS STRING) AS source_id FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey, l_linenumber % 3, l_suppkey % 60"
_GRAPH_USE = "SELECT 'q' || CAST(o_orderkey AS STRING) AS query_id, CASE o_custkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'data' ELSE 'object' END AS kind, 'urn:lake:' || o_orderpriority AS target FROM orders"


@register(
    REGISTRY,
    "eval_gold_derive",
    f"SELECT DISTINCT s.source_id, g.target, '' AS issue FROM ({_SQL_USE}) s JOIN ({_GRAPH_USE}) g USING (query_id, kind) UNION ALL SELECT '', target, 'source_not_in_gold' FROM ({_GRAPH_USE}) WHERE (query_id, kind) NOT IN (SELECT (query_id, kind) FROM ({_SQL_USE}))",
)
def _(spark, d):
    s, g = ask(spark, d, _SQL_USE), ask(spark, d, _GRAPH_USE)
    found = ops.gold_from_queries(s, g).withColumn("issue", F.lit(""))
    lost = g.join(s, ["query_id", "kind"], "left_anti").select(F.lit("").alias("source_id"), "target", F.lit("source_not_in_gold").alias("issue"))
    return found.unionByName(lost)


@register(REGISTRY, "eval_artifact_join", f"SELECT item_id, doc_id, lang, source, rank FROM {BM25_RANKED} JOIN documents USING (doc_id) WHERE rank <= 8")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    top = bm25_ranked(spark, d).filter("rank <= 8").join(docs, "doc_id", "left")
    checked = F.when(F.col("lang").isNull(), F.raise_error(F.lit("a candidate without record")).cast("string")).otherwise(F.col("lang"))
    return top.select("item_id", "doc_id", checked.alias("lang"), "source", F.col("rank").cast("long"))
