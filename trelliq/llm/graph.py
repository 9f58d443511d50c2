"""Connected components of link tables: contraction where the links lie, then alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Links that one task contracts in memory.
TASK_LINKS = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node with the smallest it is linked with."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(names[root[out]])], ["u", "v"])


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of ``links`` the smallest node that it is linked with, itself included.

    Each task first contracts the links that it reads, TASK_LINKS at most, to stars; where that takes several tasks,
    large and small star steps turn links towards the smallest neighbour until each component is a star: a number of
    rounds logarithmic in its diameter. Minima are partial aggregates and hubs meet their links in joins that Spark
    may split, so no neighbourhood is ever gathered; each round is written, so a lost executor costs one round.
    """
    pairs = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v")
    pairs = scratch.keep(pairs, "links")
    tasks = max(1, -(-pairs.count() // TASK_LINKS))
    few = pairs.coalesce(1) if tasks == 1 else pairs.repartition(tasks)
    new = scratch.keep(few.mapInArrow(_contract, "u long, v long").distinct() if tasks > 1 else few.mapInArrow(_contract, "u long, v long"), "links")
    scratch.drop(pairs)
    pairs = new
    if tasks == 1:
        return _named(pairs)
    before = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()  # one row
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
        # large star: a node's larger neighbours are linked with its smallest neighbour (or itself)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked with the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.drop(pairs)
        pairs = new
    return _named(pairs)


def _named(pairs: DataFrame) -> DataFrame:
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
