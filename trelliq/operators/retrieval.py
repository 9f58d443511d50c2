"""Ranked candidates: lexical, vector and fused lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..lineage import spread

K1, B = 1.5, 0.75
#: Constant of reciprocal rank fusion.
RRF = 60


def ranked(scored: DataFrame, source: str, target: str, score: Column, k: int | None = None, descending: bool = True) -> DataFrame:
    """Ranks from 1 by score, then by target; only the first k of a source leave its partitions."""
    w = Window.partitionBy(source).orderBy(F.desc("score") if descending else F.asc("score"), target)
    out = scored.withColumn("score", score).withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


#: Sources or targets of a kind that are broadcast at most, and rows of a block of vectors.
BROADCAST_ROWS, BLOCK = 100_000, 2048


def every_target(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source with all targets: few targets go to every task; more are dealt to blocks, and sources to each block."""
    count = targets.count()
    if count <= BROADCAST_ROWS:
        return sources.join(F.broadcast(targets))
    blocks = -(-count // BROADCAST_ROWS)
    t = targets.withColumn("_b", F.pmod(F.xxhash64(*targets.columns), F.lit(blocks)).cast("int"))
    return sources.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(t, "_b").drop("_b")


def discriminator_scores(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, base, target, parent, score > 0): discriminator columns of tables against classes.

    4 for each shared word, 2 for each word shared with the table's own class, 8 if that is the class's parent, 3 if all
    of the column's words are there.
    """
    s = sources.withColumn("_w", text.word_set(F.regexp_replace("source", "^is_", " "))).withColumn("_b", text.word_set(F.col("base")))
    t = targets.withColumn("_c", text.word_set(F.col("target")))
    both = F.size(F.array_intersect("_w", "_c"))
    score = 4 * both + 2 * F.size(F.array_intersect("_b", "_c")) + F.when(F.lower("parent") == F.col("base"), 8).otherwise(0) + F.when(both == F.size("_w"), 3).otherwise(0)
    return every_target(s, t).select("source", "base", "target", "parent", score.alias("score")).filter("score > 0")


def bm25(sources: DataFrame, targets: DataFrame, source: str, target: str, column: str = "text") -> DataFrame:
    """(source, target, score) of every pair that shares a term; a term counts as often as the source repeats it.

    Only terms that some source has leave the targets: few of them are broadcast to where texts are split, more are
    joined. Terms are counted per target before anything moves; document frequencies come from the counts.
    """
    q = text.each(sources.select(source, text.tokens(F.col(column)).alias("_t")), "_t", "term").groupBy(source, "term").agg(F.count("*").alias("qtf"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    split = spread(targets).select(target, text.tokens(F.col(column)).alias("_t"))
    t = text.each(split.withColumn("dl", F.size("_t")), "_t", "term").join(few(q.select("term").distinct()), "term", "left_semi")
    # a target's counts lie together, so that its scores are summed up where they are
    t = t.groupBy(target, "dl", "term").agg(F.count("*").alias("tf")).repartition(target)
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    n, total = split.agg(F.count("*").alias("n"), F.sum(F.size("_t")).alias("total")).first()  # two numbers
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (F.lit(float(total or 0)) / F.lit(float(max(n, 1))))))
    weighted = q.join(df, "term").select(source, "term", (F.col("qtf") * weight).alias("w"))
    weighted = F.broadcast(weighted) if q.count() <= BROADCAST_ROWS else weighted  # a row a source's term
    return t.select(target, "term", saturated.alias("s")).join(weighted, "term").groupBy(source, target).agg(F.sum(F.col("w") * F.col("s")).alias("score"))


def dense(sources: DataFrame, targets: DataFrame, source: str, target: str, kind: str = "kind", vector: str = "vector", zero: str = "zero") -> DataFrame:
    """(source, target, score): cosines of all targets of a source's kind."""
    t = targets.select(F.col(target), F.col(kind), F.col(vector).alias("_t"))
    return sources.join(t, kind).select(source, target, vectors.cosine(F.col(vector), F.col("_t"), zero).alias("score"))


def dense_top(sources: DataFrame, targets: DataFrame, source: str, target: str, k: int, kind: str = "kind", vector: str = "vector", zero: str = "zero", digits: int = 6) -> DataFrame:
    """(source, target, score): each source's k best targets of its kind by cosine rounded to ``digits``, then by target.

    Vectors of a kind are dealt to blocks of BLOCK rows, so no kind is held whole. A pair of blocks is one matrix product
    whose k best a source leave the task. Cosines of a zero vector, and of vectors of other lengths, are 0, or an error
    where ``zero`` is ``"error"``.
    """
    import numpy as np
    import pandas as pd

    def dealt(df: DataFrame, key: str, tag: str) -> tuple[DataFrame, DataFrame]:
        count = df.groupBy(kind).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"_n{tag}"))
        rows = df.select(kind, F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).join(count, kind)
        return rows.withColumn(f"_{tag}", F.pmod(F.xxhash64("id"), F.col(f"_n{tag}")).cast("int")), count

    a, counts_a = dealt(sources, source, "a")
    b, counts_b = dealt(targets, target, "b")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    a = a.join(counts_b, kind).withColumn("_b", F.explode(each("_nb"))).select(kind, "_a", "_b", "id", "v")
    b = b.join(counts_a, kind).withColumn("_a", F.explode(each("_na"))).select(kind, "_a", "_b", "id", "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id", kind="stable")
        out = []
        sizes, widths = left["v"].map(len).to_numpy(), right["v"].map(len).to_numpy()
        ids = right["id"].to_numpy()
        for d in np.unique(sizes):
            some = left[sizes == d]
            x = np.stack(some["v"].to_numpy())
            scores = np.zeros((len(x), len(ids)))
            fits = widths == d
            if fits.any():
                y = np.stack(right["v"].to_numpy()[fits])
                nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                n = nx[:, None] * ny[None]
                if zero == "error" and (n == 0).any():
                    raise ValueError("a zero vector has no cosine")
                scores[:, fits] = np.divide(x @ y.T, n, out=np.zeros_like(n), where=n > 0)
            if zero == "error" and not fits.all():
                raise ValueError("vectors of different lengths have no cosine")
            order = np.argsort(-np.round(scores, digits), axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"source": np.repeat(some["id"].to_numpy(), order.shape[1]), "target": ids[order.ravel()], "score": np.take_along_axis(scores, order, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"source": [], "target": [], "score": []})

    a, b = a.toDF("k", "i", "j", "id", "v"), b.toDF("k", "i", "j", "id", "v")
    on = ["k", "i", "j"]
    types = [df.schema[c].dataType.simpleString() for df, c in ((sources, source), (targets, target))]
    found = a.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(lambda x, y: best(x, y) if len(x) and len(y) else best(x[:0], y), f"source {types[0]}, target {types[1]}, score double")
    return found.select(F.col("source").alias(source), F.col("target").alias(target), "score")


def sparse_dot(sources: DataFrame, targets: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, dot) of hashed embeddings given as (key, idx, w); pairs without a common coordinate are left out.

    A target's coordinates lie together, and few sources' coordinates go to all of them, so that a pair is summed up where
    its target is; of more sources, pairs are summed up in part before they move.
    """
    a = sources.withColumnRenamed("w", "a")
    a = F.broadcast(a) if a.count() <= BROADCAST_ROWS else a
    return targets.withColumnRenamed("w", "b").join(a, "idx").groupBy(source, target).agg(F.sum(F.col("a") * F.col("b")).alias("dot"))


def fuse(lists: list[DataFrame], source: str, target: str) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: score = sum of 1 / (60 + rank)."""
    every = lists[0].select(source, target, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(source, target, "rank"))
    return every.groupBy(source, target).agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score"))
