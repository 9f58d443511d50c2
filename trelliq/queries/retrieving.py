"""ret_*: candidates for source texts, names and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import decisions
from ..operators import retrieval as ops
from .base import register, table
from .corpus import ask

REGISTRY: dict = {}


def tokens_sql(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '[_\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> '')"


def words_sql(c: str) -> str:
    grown = f"flatten(list_transform({tokens_sql(c)}, lambda w: list_concat([w], CASE WHEN w = 'conf' THEN ['conference'] WHEN w = 'pc' THEN ['program', 'committee'] ELSE [] END, CASE WHEN w LIKE '%ies' THEN [substr(w, 1, length(w) - 3) || 'y'] ELSE [] END, CASE WHEN w LIKE '%s' AND length(w) > 3 THEN [substr(w, 1, length(w) - 1)] ELSE [] END)))"
    return f"list_distinct({grown})"


@register(REGISTRY, "ret_tokens", f"SELECT item_id, len({tokens_sql('text')}) AS n_tokens, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM benchmark")
def _(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register(REGISTRY, "ret_words", f"SELECT item_id, array_to_string(list_sort({words_sql('text')}), ' ') AS words FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(text.word_set(F.col("text"))), " ").alias("words"))


_NAMES = "(SELECT DISTINCT p_type AS source FROM part) s, (SELECT DISTINCT p_name AS target FROM part) t"


def names(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_type").alias("source")).distinct(), part.select(F.col("p_name").alias("target")).distinct()


def pairs(spark, d):
    """Names of sources with those of all targets."""
    return ops.every_target(*names(spark, d))


_BONUS = f"(SELECT source, target, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE least(1.0, (len(list_intersect(a, b)) + CASE WHEN len(list_intersect(a, b)) IN (len(a), len(b)) THEN 2 ELSE 0 END) * 0.35) END AS bonus FROM (SELECT source, target, {words_sql('source')} AS a, {words_sql('target')} AS b FROM {_NAMES}))"


@register(REGISTRY, "ret_lexical_bonus", f"SELECT source, target, round(bonus, 6)::DOUBLE AS bonus FROM {_BONUS}")
def _(spark, d):
    return pairs(spark, d).select("source", "target", F.round(text.lexical_bonus(text.word_set(F.col("source")), text.word_set(F.col("target"))), 6).alias("bonus"))


@register(REGISTRY, "ret_verbalize", "SELECT p_partkey, concat_ws(chr(10), 'kind: part', 'name: ' || p_name, CASE WHEN p_size > 25 THEN 'size: ' || p_size END, 'type: ' || p_type) AS text FROM part")
def _(spark, d):
    lines = [F.lit("kind: part"), F.concat(F.lit("name: "), "p_name"), F.when(F.col("p_size") > 25, F.concat(F.lit("size: "), F.col("p_size").cast("string"))), F.concat(F.lit("type: "), "p_type")]
    return table(spark, d, "part").select("p_partkey", F.concat_ws("\n", *lines).alias("text"))


@register(REGISTRY, "ret_compact", r"SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 177)) || '...' END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compact(F.col("text"), 180).alias("text"))


def _embed_sql(rel: str, key: str, c: str) -> str:
    toks = rf"(SELECT {key} AS k, unnest(list_filter(string_split_regex(lower({c}), '\s+'), lambda t: t <> '')) AS t FROM {rel})"
    coords = f"(SELECT k, CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 256 AS idx, sum(CASE WHEN CAST('0x' || substr(sha256(t), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM {toks} GROUP BY ALL HAVING s <> 0)"
    return f"(SELECT k, idx, s / sqrt(sum(s * s) OVER (PARTITION BY k)) AS w FROM {coords})"


@register(REGISTRY, "ret_hash_embedding", f"SELECT k AS item_id, CAST(idx AS INT) AS idx, round(w, 6) AS w FROM {_embed_sql('benchmark', 'item_id', 'text')}")
def _(spark, d):
    return vectors.hash_embedding(table(spark, d, "benchmark"), "item_id", "text").withColumn("w", F.round("w", 6))


@register(REGISTRY, "ret_cache_miss", "SELECT DISTINCT sha256('hash|256|v1|' || text) AS key FROM documents WHERE sha256('hash|256|v1|' || text) NOT IN (SELECT sha256('hash|256|v1|' || text) FROM benchmark UNION SELECT sha256('hash|256|v1|' || text) FROM documents WHERE lang = 'de')")
def _(spark, d):
    key = F.sha2(F.concat(F.lit("hash|256|v1|"), "text"), 256).alias("key")
    docs = table(spark, d, "documents")
    cached = table(spark, d, "benchmark").select(key).union(docs.filter("lang = 'de'").select(key))
    return docs.select(key).distinct().join(cached, "key", "left_anti")


_COS = "(SELECT a.vec_id AS source, b.vec_id AS target, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"


def _cosines(spark, d, zero, k):
    """The best targets of each vector among others of its label; one more than asked for, as a vector finds itself."""
    e = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("label").alias("kind"), F.col("embedding").alias("vector"))
    best = ops.dense_top(e.withColumnRenamed("vec_id", "source"), e.withColumnRenamed("vec_id", "target"), "source", "target", k + 1, zero=zero)
    return best.filter("source <> target")


@register(REGISTRY, "ret_cosine", f"SELECT source, target, rank, round(1 - s, 6) AS distance FROM (SELECT source, target, round(score, 6) AS s, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, target) AS rank FROM {_COS}) WHERE rank <= 16")
def _(spark, d):
    return ops.ranked(_cosines(spark, d, "error", 16), "source", "target", F.round("score", 6), 16).select("source", "target", F.col("rank").cast("long"), F.round(1 - F.col("score"), 6).alias("distance"))


@register(REGISTRY, "ret_squared_l2", "SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    return e.join(after, "vec_id").select("vec_id", F.round(vectors.squared_l2(F.col("embedding"), F.col("_next")), 6).alias("distance"))


@register(REGISTRY, "ret_dense", f"SELECT source, target, s AS score, rank FROM (SELECT source, target, round(score, 6) AS s, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, target) AS rank FROM {_COS}) WHERE rank <= 20")
def _(spark, d):
    return ops.ranked(_cosines(spark, d, "zero", 20), "source", "target", F.round("score", 6), 20).select("source", "target", "score", F.col("rank").cast("long"))


_DOT = f"(SELECT source, target, coalesce((SELECT sum(a.w * b.w) FROM {_embed_sql('(SELECT DISTINCT p_type FROM part)', 'p_type', 'p_type')} a JOIN {_embed_sql('(SELECT DISTINCT p_name FROM part)', 'p_name', 'p_name')} b ON a.idx = b.idx WHERE a.k = source AND b.k = target), 0) AS dot FROM {_NAMES})"


def _dots(spark, d):
    s, t = names(spark, d)
    dots = ops.sparse_dot(vectors.hash_embedding(s, "source", "source"), vectors.hash_embedding(t, "target", "target"), "source", "target")
    return pairs(spark, d).join(dots, ["source", "target"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


@register(REGISTRY, "ret_legacy_l2", f"SELECT source, target, round(2 - 2 * dot, 6) AS distance, row_number() OVER (PARTITION BY source ORDER BY round(2 - 2 * dot - bonus, 6), target) AS rank FROM {_DOT} JOIN {_BONUS} USING (source, target) QUALIFY rank <= 20")
def _(spark, d):
    bonus = text.lexical_bonus(text.word_set(F.col("source")), text.word_set(F.col("target")))
    made = _dots(spark, d).withColumn("distance", F.round(2 - 2 * F.col("dot"), 6))
    out = ops.ranked(made, "source", "target", F.round(2 - 2 * F.col("dot") - bonus, 6), 20, descending=False)
    return out.select("source", "target", "distance", F.col("rank").cast("long"))


def _compact(c: str) -> str:
    return f"array_to_string({tokens_sql(c)}, ' ')"


_LEV = f"(SELECT source, target, round(1 - levenshtein({_compact('source')}, {_compact('target')}) / greatest(length({_compact('source')}), length({_compact('target')})), 6)::DOUBLE AS score FROM {_NAMES})"
_LEV_RANKED = f"(SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM {_LEV})"
_DENSE_RANKED = f"(SELECT source, target, round(dot, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(dot, 6) DESC, target) AS rank FROM {_DOT})"


def _levenshtein(spark, d):
    flat = lambda c: F.array_join(text.tokens(F.col(c)), " ")
    return ops.ranked(pairs(spark, d), "source", "target", F.round(text.similarity(flat("source"), flat("target")), 6))


@register(REGISTRY, "ret_levenshtein", f"SELECT * FROM {_LEV_RANKED} WHERE rank <= 16")
def _(spark, d):
    return _levenshtein(spark, d).filter("rank <= 16").withColumn("rank", F.col("rank").cast("long"))


def fused_sql(a: str, b: str, s: str, t: str, k: int) -> str:
    summed = f"(SELECT {s}, {t}, round(sum(1 / (60.0::DOUBLE + r)), 9) AS score FROM (SELECT {s}, {t}, rank AS r FROM {a} UNION ALL SELECT {s}, {t}, rank FROM {b}) GROUP BY {s}, {t})"
    return f"SELECT * FROM (SELECT {s}, {t}, score, row_number() OVER (PARTITION BY {s} ORDER BY score DESC, {t}) AS rank FROM {summed}) WHERE rank <= {k}"


@register(REGISTRY, "ret_rrf_lev_dense", fused_sql(_LEV_RANKED, _DENSE_RANKED, "source", "target", 16))
def _(spark, d):
    dense = ops.ranked(_dots(spark, d), "source", "target", F.round("dot", 6))
    both = ops.fuse([_levenshtein(spark, d), dense], "source", "target")
    return ops.ranked(both, "source", "target", F.round("score", 9), 16).withColumn("rank", F.col("rank").cast("long"))


BM25_SQL = f"""(SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM
(SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({tokens_sql('text')}) AS t FROM benchmark) GROUP BY ALL) q
JOIN (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS t FROM documents) GROUP BY ALL) d USING (t)
JOIN (SELECT t, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS t FROM documents) GROUP BY t) f USING (t)
JOIN (SELECT doc_id, len({tokens_sql('text')}) AS dl FROM documents) l USING (doc_id),
(SELECT count(*) AS n, avg(len({tokens_sql('text')})) AS avgdl FROM documents) GROUP BY item_id, doc_id)"""
BM25_RANKED = f"(SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {BM25_SQL})"


def bm25_ranked(spark, d):
    made = ops.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")
    return ops.ranked(made, "item_id", "doc_id", F.round("score", 6))


@register(REGISTRY, "ret_bm25", f"SELECT * FROM {BM25_RANKED} WHERE rank <= 16")
def _(spark, d):
    return bm25_ranked(spark, d).filter("rank <= 16").withColumn("rank", F.col("rank").cast("long"))


_TEXT_DENSE = f"(SELECT a.k AS item_id, b.k AS doc_id, row_number() OVER (PARTITION BY a.k ORDER BY round(sum(a.w * b.w), 6) DESC, b.k) AS rank FROM {_embed_sql('benchmark', 'item_id', 'text')} a JOIN {_embed_sql('documents', 'doc_id', 'text')} b ON a.idx = b.idx GROUP BY a.k, b.k)"


@register(REGISTRY, "ret_rrf_bm25_dense", fused_sql(BM25_RANKED, _TEXT_DENSE, "item_id", "doc_id", 16))
def _(spark, d):
    dots = ops.sparse_dot(vectors.hash_embedding(table(spark, d, "benchmark"), "item_id", "text"), vectors.hash_embedding(table(spark, d, "documents"), "doc_id", "text"), "item_id", "doc_id")
    dense = ops.ranked(dots, "item_id", "doc_id", F.round("dot", 6))
    both = ops.fuse([bm25_ranked(spark, d), dense], "item_id", "doc_id")
    return ops.ranked(both, "item_id", "doc_id", F.round("score", 9), 16).withColumn("rank", F.col("rank").cast("long"))


#: Discriminator columns of tables, and classes with their parents, as parts name them.
_COLUMNS = "SELECT DISTINCT 'is_' || replace(p_name, ' ', '_') AS source, lower(p_type) AS base FROM part WHERE p_size % 4 = 0"
_CLASSES = "SELECT DISTINCT replace(p_name, ' ', '-') AS target, p_type AS parent FROM part WHERE p_size % 3 = 0"


@register(
    REGISTRY,
    "ret_discriminator",
    f"SELECT source, base, target, parent, score, row_number() OVER (PARTITION BY source, base ORDER BY score DESC, target, parent) AS rank FROM (SELECT source, base, target, parent, 4 * len(list_intersect(w, c)) + 2 * len(list_intersect(b, c)) + CASE WHEN lower(parent) = base THEN 8 ELSE 0 END + CASE WHEN len(list_intersect(w, c)) = len(w) THEN 3 ELSE 0 END AS score FROM "
    f"(SELECT source, base, target, parent, {words_sql('regexp_replace(source, chr(94) || chr(105) || chr(115) || chr(95), chr(32))')} AS w, {words_sql('base')} AS b, {words_sql('target')} AS c FROM ({_COLUMNS}) s, ({_CLASSES}) t)) WHERE score > 0 QUALIFY rank <= 16",
)
def _(spark, d):
    made = ops.discriminator_scores(ask(spark, d, _COLUMNS), ask(spark, d, _CLASSES))
    w = Window.partitionBy("source", "base").orderBy(F.desc("score"), "target", "parent")
    return made.withColumn("rank", F.row_number().over(w)).filter("rank <= 16").withColumns({c: F.col(c).cast("long") for c in ("score", "rank")})


@register(REGISTRY, "ret_offline_match", f"SELECT source, target, 0.5::DOUBLE AS confidence FROM {_LEV_RANKED} WHERE rank = 1")
def _(spark, d):
    return decisions.FirstCandidate().decide(_levenshtein(spark, d))


@register(REGISTRY, "ret_override", f"SELECT source, CASE WHEN source LIKE 'S%' THEN 'forced' ELSE target END AS target, CASE WHEN source LIKE 'S%' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM {_LEV_RANKED} WHERE rank = 1")
def _(spark, d):
    forced = names(spark, d)[0].filter("source LIKE 'S%'").withColumn("target", F.lit("forced"))
    return decisions.Override(decisions.FirstCandidate(), forced).decide(_levenshtein(spark, d))


@register(REGISTRY, "ret_group_chunks", "SELECT o_custkey, CAST((r - 1) // 12 AS INT) AS chunk, count(*) AS n FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY ALL")
def _(spark, d):
    return decisions.chunks(table(spark, d, "orders"), "o_custkey", "o_orderkey").groupBy("o_custkey", "chunk").agg(F.count("*").alias("n"))
