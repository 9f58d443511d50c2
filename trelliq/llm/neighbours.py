"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one queue over all of them.

The trees are fitted on a bounded sample; every vector is then routed to one leaf a tree. A query takes leaves of all
trees from one priority queue, by the margin of the worst split on the way, until the leaves taken hold the wanted
number of vectors; the leaves' vectors are reranked by the exact inner product in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hash_sample
from .vectors import digests, matrix, usable

#: Vectors that the trees are fitted on at most, about: a bounded sample by a hash of the vector.
FIT_ROWS = 20_000
TREES = 8
#: Leaves of a tree, at least and at most, and vectors for each: their number is bounded, so they grow with the data and
#: are split into blocks.
LEAVES, MOST_LEAVES, LEAF_ROWS = 32, 256, 1024
#: A query stops when the leaves it took hold so many vectors as a share of all, up to SHARE_ROWS of them (a vector counts
#: once a tree: its share of distinct ones is about 0.7). Evenly spread vectors of 64 dimensions are the worst case, for
#: which this gives a recall above 0.9; of more vectors the nearest lie closer, and the share falls with each tenfold.
SHARE, SHARE_ROWS, SHARE_FALLS, LEAST_SHARE = 1.2, 2000, 0.17, 0.1
BLOCK = 2048
#: Queries that meet a block in one task at most, about.
ASKERS = 8192


@dataclass
class Tree:
    normal: np.ndarray
    offset: np.ndarray
    #: Children of an inner node; a leaf has -1 and its number.
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.left[node] < 0:
                out[rows] = self.leaf[node]
                continue
            over = x[rows] @ self.normal[node] > self.offset[node]
            stack.append((self.left[node], rows[~over]))
            stack.append((self.right[node], rows[over]))
        return out


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
    """Splits at the median along the difference of two random members, until ``leaves`` leaves or equal members."""
    normal, offset, left, right, leaf = [], [], [], [], []

    def node() -> int:
        normal.append(np.zeros(sample.shape[1])), offset.append(0.0), left.append(-1), right.append(-1), leaf.append(-1)
        return len(left) - 1

    queue = [(node(), np.arange(len(sample)), leaves)]
    count = 0
    while queue:
        me, rows, room = queue.pop()
        split = None
        if room > 1 and len(rows) > 8:
            for _ in range(4):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                w = a - b
                if not np.any(w):
                    continue
                w = w / np.linalg.norm(w)
                along = sample[rows] @ w
                cut = float(np.median(along))
                if (along > cut).any():
                    split = w, cut, along > cut
                    break
        if split is None:
            leaf[me] = count
            count += 1
            continue
        normal[me], offset[me], over = split
        left[me], right[me] = node(), node()
        queue.append((left[me], rows[~over], room // 2))
        queue.append((right[me], rows[over], room - room // 2))
    return Tree(np.array(normal), np.array(offset), np.array(left), np.array(right), np.array(leaf))


def visit(forest: list[Tree], sizes: list[np.ndarray], q: np.ndarray, want: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of a queue that all trees share, until the leaves hold ``want`` vectors."""
    margins = [t.normal @ q - t.offset for t in forest]
    queue = [(-np.inf, k, 0) for k in range(len(forest))]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < want:
        worst, k, n = heapq.heappop(queue)
        t = forest[k]
        if t.left[n] < 0:
            if size := sizes[k][t.leaf[n]]:
                out.append((k, int(t.leaf[n])))
                held += size
            continue
        m = margins[k][n]
        heapq.heappush(queue, (max(worst, m), k, int(t.left[n])))
        heapq.heappush(queue, (max(worst, -m), k, int(t.right[n])))
    return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled by the longest and lifted to the unit sphere, where the nearest has the largest inner product."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))], axis=1)


def leaves_for(n: int) -> int:
    """Leaves of a tree over ``n`` vectors."""
    return min(MOST_LEAVES, max(LEAVES, n // LEAF_ROWS))


def share_for(n: int) -> float:
    """The share of ``n`` vectors that a query's leaves hold."""
    return max(LEAST_SHARE, SHARE - SHARE_FALLS * math.log10(max(n, SHARE_ROWS) / SHARE_ROWS))


def nearest(rows: DataFrame, k: int = 20, every: int = 20, trees: int = TREES, leaves: int | None = None, share: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every`` the k others with the largest inner product found.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Ties go to the smaller id.
    Equal vectors are searched once and told apart at the end, where a query needs the k + 1 smallest ids of a class
    at most, so copies cost nothing and none is lost. Rows of one id are one vector. Each vector length is searched by
    itself: vectors of another length than the query's have no inner product with it. An empty table gives an empty
    result; other columns are not read.
    """
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    widths = [r["d"] for r in base.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # a row a vector length
    out = None
    for width in widths or [0]:
        found = _nearest_of(base.filter(F.size("v") == width).select("vec_id", "v", *digests(F.col("v"))), width, k, every, trees, leaves, share)
        out = found if out is None else out.unionByName(found)
    return out


def _nearest_of(base: DataFrame, width: int, k: int, every: int, trees: int, leaves: int | None, share: float | None) -> DataFrame:
    """The search over usable vectors of one length."""
    spark = base.sparkSession
    scratch = Scratch(spark, "near")
    # one row a distinct vector; c is its number
    unique = base.groupBy("_h1", "_h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("c"), F.max(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("asks"))
    unique = scratch.keep(unique, "unique")
    n = unique.count()
    leaves, share = leaves or leaves_for(n), share or share_for(n)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = float(unique.agg(F.max(norm)).first()[0] or 1.0)
    held = hash_sample(unique.select("_h1", "v"), "_h1", n, FIT_ROWS).select("v").toPandas()["v"].to_numpy()  # FIT_ROWS rows at most, about
    rng = np.random.default_rng(20)
    sample = _lifted(np.stack(held).astype(np.float64), longest) if len(held) else np.zeros((0, width + 1))
    forest = [grow(sample, leaves, rng) for _ in range(trees)] if len(sample) else []

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lifted(matrix(batch.column(1)), longest)
            found = np.stack([t.route(x) for t in forest], axis=1) if len(x) and forest else np.zeros((len(batch), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))], ["c", "v", "asks", "leaves"])

    vector = unique.schema["v"].dataType.simpleString()
    indexed = scratch.keep(unique.select("c", "v", "asks").mapInArrow(index, f"c long, v {vector}, asks int, leaves array<int>"), "index")
    postings = indexed.select("c", "v", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = [np.zeros(leaves, np.int64) for _ in forest]
    for r in indexed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect():  # trees x leaves rows
        sizes[r["tree"]][r["leaf"]] = r["n"]
    blocks = [np.maximum(1, -(-s // BLOCK)) for s in sizes]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            lifted = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1) if len(x) else x
            at, tree, leaf, part = [], [], [], []
            for i in range(len(x)):
                for t, f in visit(forest, sizes, lifted[i], share * n):
                    for b in range(int(blocks[t][f])):
                        at.append(i), tree.append(t), leaf.append(f), part.append(b)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(z, pa.int32()) for z in (tree, leaf, part)]], ["q", "w", "tree", "leaf", "part"])

    asked = indexed.filter("asks = 1").select("c", "v").mapInArrow(ask, f"q long, w {vector}, tree int, leaf int, part int")
    table = F.array(*[F.array(*[F.lit(int(b)) for b in bs]) for bs in blocks]) if forest else F.array(F.array(F.lit(1)))
    parts = F.element_at(F.element_at(table, F.col("tree") + 1), F.col("leaf") + 1)
    # neither side of a block grows with the table: its vectors are dealt to parts, and so are those that ask, to turns
    turns = max(1, -(-indexed.filter("asks = 1").count() // ASKERS))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int"))
    stored = postings.withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def rerank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
        left = left.sort_values("c", kind="stable")
        ids, x = left["c"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.float64)
        take = min(k + 1, len(ids))
        out_q, out_c, out_s = [], [], []
        for a in range(0, len(right), 256):
            some = right.iloc[a : a + 256]
            scores = np.stack(some["w"].to_numpy()).astype(np.float64) @ x.T
            least = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
            q, c = np.nonzero(scores >= least[:, None])  # with all ties of the last one
            out_q.append(some["q"].to_numpy()[q]), out_c.append(ids[c]), out_s.append(scores[q, c])
        return pd.DataFrame({"q": np.concatenate(out_q), "c": np.concatenate(out_c), "s": np.concatenate(out_s)})

    on = ["tree", "leaf", "part", "turn"]
    found = stored.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(rerank, "q long, c long, s double")
    # a vector that several trees gave is one candidate
    best = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    top = found.groupBy("q", "c").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("q", "c", "s")
    members = base.select("vec_id", "_h1", "_h2").distinct().withColumn("m", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("vec_id"))).filter(F.col("m") <= k + 1)
    names = unique.select("_h1", "_h2", "c")
    few = members.join(names, ["_h1", "_h2"]).groupBy("c").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    # at most k + 1 classes of k + 1 ids a query class: the k + 1 best ids, then each asking row without itself
    ids = top.join(few, "c").select("q", "s", F.explode("ids").alias("vec_id"))
    kept = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).filter(F.col("r") <= k + 1)
    answer = kept.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "s"))).alias("best"))  # k + 1 at most
    asking = base.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "_h1", "_h2").distinct().join(names, ["_h1", "_h2"])
    out = asking.join(answer, asking["c"] == answer["q"]).select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    flat = out.select("query_id", F.posexplode("best").alias("i", "b"))
    return flat.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.s").alias("score"))
