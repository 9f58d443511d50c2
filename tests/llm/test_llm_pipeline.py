import random
import re
from fractions import Fraction

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_documents import brute

from trelliq.llm import langid, packing, quality
from trelliq.llm.queries import tokenizer

SF = "/root/testdata/sf0.01"
ODD = [(-1, None, "en"), (-2, "", None), (None, "the house and the garden", "en"), (-3, "12 34 — …", "en"), (-4, "word " * 30_000, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, some of them again, odd texts and columns named like those that the operators add."""
    held = spark.read.parquet(f"{SF}/documents.parquet")
    some = held.filter("doc_id < 40")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string").select("doc_id", "text", "lang", F.lit("odd").alias("source"), F.length("text").cast("long").alias("n_chars"))
    every = held.unionByName(some).unionByName(odd.select(*[F.col(f.name).cast(f.dataType) for f in held.schema.fields]))
    return every.withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit("x")).withColumn("component_id", F.lit(-9)).withColumn("predicted", F.lit(7)).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_stage_keeps_what_the_scores_say(spark, docs):
    got = corpus_pipeline.quality_stage(spark, docs, SF)
    assert got.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    held = docs.collect()
    scores = model.score(quality.statistics(pa.array([r.text for r in held], pa.string())))
    assert rows_of(got) == sorted((tuple(r) for r, s in zip(held, scores, strict=True) if s >= corpus_pipeline.QUALITY), key=repr)


def test_language_stage_keeps_what_the_labels_say(spark, docs):
    got = corpus_pipeline.language_stage(spark, docs, SF)
    import pyarrow as pa

    held = docs.collect()
    names, scores = langid.fit(docs).label(pa.array([r.text for r in held], pa.string()))
    want = [tuple(r) for r, n, s in zip(held, names.to_pylist(), scores.to_pylist(), strict=True) if n != "und" and s >= corpus_pipeline.LANGUAGE_SHARE]
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=repr)


def test_near_duplicate_stage_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(60)]) for _ in range(rng.choice([2, 30, 80])))) for i in range(60)]
    for i in range(60, 110):  # copies of four in five shingles, about
        words = rows[rng.randrange(60)][1].split()
        words[rng.randrange(len(words))] = "other"
        rows.append((i, " ".join(words)))
    rows += [(5, rows[5][1]), (200, None), (201, ""), (202, None), (None, "w1 w2 w3")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    got = corpus_pipeline.near_duplicate_stage(spark, df, SF)
    groups = brute([r for r in rows if r[0] is not None], 5, Fraction(4, 5))
    gone = {i for i, (n, c) in groups.items() if n and c != i}
    assert gone and rows_of(got) == sorted(((*r, "c") for r in rows if r[0] not in gone), key=repr)


def test_packing_stage_is_near_the_least(spark, docs):
    some = docs.filter("doc_id < 200 OR doc_id IS NULL")
    got = corpus_pipeline.packing_stage(spark, some, SF).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= 1.02 * -(-int(got.length.sum()) // 2048)  # no packing can have less than that
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    sizes = packing.document_pieces(some, tokenizer("byte_bpe_50k.json"), 1 << 40, 0).select("doc_id", "length").collect()
    assert sorted(repr((r.doc_id, r.length)) for r in sizes) == sorted(repr((None if i != i else int(i), int(n))) for i, n in _whole(got))


def _whole(got):
    """(doc_id, tokens) of each document, put together from its pieces."""
    import pandas as pd

    got = got.sort_values(["doc_id", "piece"])
    one = got.groupby(["doc_id", "piece"], dropna=False).size()
    for doc, g in got.groupby("doc_id", dropna=False):
        times = int(one.loc[doc].iloc[0]) if not pd.isna(doc) else int((got.doc_id.isna() & (got.piece == 0)).sum())
        for _ in range(times):
            yield doc, g.length.sum() / times


def test_stages_on_an_empty_table(spark, docs):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert rows_of(got.select(*key)) == rows_of(docs.select(*key)) and got.count() > 100
    assert re.fullmatch(r"\w+", corpus_pipeline.STAGES[2][0])
