"""From raw documents to packed training sequences: quality, language, near duplicates, packing.

Each stage works on all that the one before it kept. All but the last return the columns of documents; the last
returns a row for each piece of a document with its place in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trelliq.llm import langid, packing, quality, shingles
from trelliq.llm.common import Scratch, table
from trelliq.llm.queries import tokenizer

#: From this score on a document's quality is good enough.
QUALITY = 0.3
#: A document goes when less of its letters than this lie in spans of one language.
LANGUAGE_SHARE = 0.5
#: Near duplicates: this many words a shingle, this Jaccard similarity or more.
WORDS, SIMILARITY = 5, Fraction(4, 5)


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], test: Column) -> DataFrame:
    """The documents that ``test`` holds for among columns that ``judge`` adds; columns of docs keep their names and values, whatever those are called."""
    inner = [f"_doc{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*inner), inner[docs.columns.index("text")])
    return judged.filter(test).select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are judged like any other, repeated rows alike. Without labelled documents all scores are one
    half and all stay. An empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d, text: quality.score_documents(d, model, text, threshold=QUALITY), F.col("predicted") == 1)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: no null texts, none without a letter, none without a language that holds half of it.

    Repeated rows are judged alike. Without documents of a known language none stays. An empty table stays empty.
    """
    model = langid.fit(docs)
    return _kept(docs, lambda d, text: langid.label_documents(d, model, text), (F.col("lang_pred") != "und") & (F.col("lang_score") >= LANGUAGE_SHARE))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Rows of one id are one document and stay or go together; rows without an id, and null or empty texts, link with
    nothing that would remove them and stay. An empty table stays empty.
    """
    groups = shingles.jaccard_groups(docs, WORDS, SIMILARITY)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 tokens. A null text is the end token alone; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither classifier; tests/llm/test_llm_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
