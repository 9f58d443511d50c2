"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, near_vectors, neighbours, packing, pieces, quality, sharding, shingles, url_filter
from .common import fold, table


def tokenizer(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, counts at most one apart (law rows). Null texts have size 1, checksum 0 and no link; equal
    texts, empty ones too, share a shard where quotas allow; a text of any length is its hash; ties go by hashes of the
    rows; repeated rows have a slot each; an empty table gives none; other columns are not read."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url. Null urls and those without :// have empty host and path and no rule; a long url is read
    whole; the longest rule wins, a score at the threshold is allowed; repeated urls count once and are judged alike; an
    empty table gives an empty result; other columns are not read."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a similarity of 0.9 of their 3-word shingles. Null, empty and blank texts link with nothing;
    texts of any length are one set; equal texts and repeated rows are one class, named by its smallest id; rows of one id
    are one document; an empty table gives an empty result; other columns are not read."""
    return shingles.jaccard_groups(table(spark, sf_dir, "documents"))


def op3_sentencepiece_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to. Null and empty texts are begin and end id alone; texts and
    words of any length are merged whole, equal ranks leftmost first; repeated rows are encoded each; an empty table gives
    an empty result; other columns are not read."""
    return pieces.digest_texts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens. Null and empty texts are the end id alone; texts of any length are cut
    into full pieces behind the first; ties go by id, piece and checksum; repeated rows are packed each; an empty table
    gives an empty result; other columns are not read."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_epsilon_grid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of one label with a cosine of 0.93 or more. Null labels, and null, empty, zero, non-finite or
    incomplete vectors, link with nothing; vectors of any length with others of it; a cosine of exactly 0.93 is a link;
    equal vectors and repeated rows count as often as they stand there; an empty table gives an empty result; other
    columns are not read."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_fourier_ridge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents. Null and empty texts are scored as empty texts; long ones whole; equal texts alike;
    repeated rows each; without labels all scores are one half; an empty table gives an empty result; lang, source and
    other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_viterbi_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. Null texts and those without a letter are und with score 0; long ones are labelled whole;
    between equal shares the first language by name wins; repeated rows are labelled alike; without a known language all
    are und; an empty table gives an empty result; other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    labelled = langid.label_documents(docs, langid.fit(docs), keep=["doc_id"])
    return labelled.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_packed_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents. Null and empty texts are the end id alone; longer texts than a row are cut without
    loss; equal lengths keep the order they are read in; a null id stays null; repeated rows are packed each; an empty
    table gives no row; other columns are not read."""
    return packing.packed_matrices(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector by inner product. Null, empty, zero, non-finite or incomplete vectors take no part;
    each vector length is searched by itself; ties go to the smaller id, across equal vectors too; rows of one id are one
    vector; an empty table gives an empty result; other columns are not read."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


_REACH = """, reach AS (SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""

_OP2 = (
    r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*)))"""
    + _REACH
    + " SELECT doc_id, len(sh) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN comp ON id = doc_id"
)

_OP6 = (
    """WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93)"""
    + _REACH
    + " SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN comp ON id = vec_id"
)


def oracle_sql() -> dict[str, str]:
    return {"op2_count_vector_join": _OP2, "op6_epsilon_grid_vectors": _OP6}
