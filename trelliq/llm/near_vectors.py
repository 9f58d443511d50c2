"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated onto leading principal directions and sorted by the grid cells (of width epsilon) of those
coordinates. The sequence is cut into blocks; pairs of blocks whose boxes lie within epsilon are joined by recursive
halving of both sequences, where halves that are provably further apart are skipped, and the rest is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hash_sample, small_batches
from .graph import components
from .vectors import digests, matrix, usable

DIMENSIONS = 6
BLOCK = 1024
LEAF = 128
#: Vectors that the principal directions are fitted on at most, about. Any rotation gives the same links.
FIT_ROWS = 20_000
#: Room for rounding in distances and boxes; what is kept is decided by the cosine itself.
SLACK = 1e-9


def _directions(unique: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length, from second moments that partitions sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(0)])
            for d in np.unique(sizes):
                x = matrix(batch.column(0).filter(pa.array(sizes == d)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                held[d] = held.get(d, 0) + one.T @ one
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["d", "m"])

    total: dict[int, np.ndarray] = {}
    sample = hash_sample(unique, "_h1", rows, FIT_ROWS).select("v").coalesce(8)
    for r in sample.mapInArrow(sums, "d int, m binary").collect():  # 8 rows a vector length at most
        total[r["d"]] = total.get(r["d"], 0) + np.frombuffer(bytes(r["m"])).reshape(r["d"] + 1, r["d"] + 1)
    out = {}
    for d, m in total.items():
        mean = m[0, 1:] / m[0, 0]
        values, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[d] = vectors[:, np.argsort(-values)[: min(DIMENSIONS, d)]]
    return out


def _join_blocks(a: tuple, b: tuple, same: bool, cosine: float, epsilon: float) -> tuple[np.ndarray, ...]:
    """Pairs (row of a, row of b) with the cosine, found by recursion over both sequences."""
    (ua, ya), (ub, yb) = a, b
    left, right = [], []
    stack = [(0, len(ua), 0, len(ub))]
    while stack:
        i, j, k, m = stack.pop()
        if same and k < i:
            continue
        gap = np.maximum(0, np.maximum(ya[i:j].min(0) - yb[k:m].max(0), yb[k:m].min(0) - ya[i:j].max(0)))
        if (gap**2).sum() > epsilon**2 + SLACK:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            found = ua[i:j] @ ub[k:m].T >= cosine
            if same and i == k:
                found = np.triu(found, 1)
            x, y = np.nonzero(found)
            left.append(x + i)
            right.append(y + k)
            continue
        # with a block against itself both sides are halved alike, so that (i, j) and (k, m) are equal or apart
        halves_a = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        halves_b = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
        stack.extend((*p, *q) for p in halves_a for q in halves_b)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked with, over the links (x, y)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: links between rows of one label with at least the cosine.

    Rows without label, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing; vectors of different lengths neither. Components are compared as they are, in double precision. Equal vectors are one in the search and count as often as they
    stand in the table: copies are never expanded into pairs. Rows of one id are one node of the components. An empty
    table gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    # unit vectors' distance: |u - v|^2 = 2 - 2 cos
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    base = base.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    keyed = base.select("vec_id", "label", "v", "ok", *digests(F.col("v")))
    group = ["label", "_h1", "_h2"]
    unique = scratch.keep(keyed.filter("ok").groupBy(*group).agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v")), "unique")
    n = unique.count()
    directions = _directions(unique, n)
    # blocks keep the components as they are: floats, or else doubles
    kind = np.dtype(np.float32 if unique.schema["v"].dataType.elementType == T.FloatType() else np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            cells, coords, sizes = [None] * len(batch), [None] * len(batch), np.array([len(x) for x in column], np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = matrix(column.take(pa.array(at)))
                turn = directions.get(int(d), np.eye(d, min(DIMENSIONS, d)))  # a length that the sample lacks: leading coordinates
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn
                grid = np.floor(y / max(epsilon, 1e-6)).astype(np.int32)
                for i, c, f in zip(at.tolist(), grid.tolist(), y.tolist(), strict=True):
                    cells[i], coords[i] = c, f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cells, pa.list_(pa.int32())), pa.array(coords, pa.list_(pa.float64()))], [*batch.schema.names, "d", "cell", "y"])

    ordered = unique.select("label", "rep", "times", "v").mapInArrow(place, _schema(unique, ["label", "rep", "times", "v"], "d int, cell array<int>, y array<double>"))
    order = ["label", "d", "cell", "y", "rep"]
    ordered = ordered.repartitionByRange(max(4, n // (8 * BLOCK)), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            y = matrix(t.column("y"))
            u = matrix(t.column("v"), kind)
            one = [pa.array([number]), t.column("label").combine_chunks().slice(0, 1), pa.array([len(u[0])], pa.int32()), pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()])]
            blobs = [t.column("rep").to_numpy().astype(np.int64), t.column("times").to_numpy().astype(np.int64), u, y]
            return pa.RecordBatch.from_arrays([*one, *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in blobs]], ["block", "label", "d", "lo", "hi", "reps", "times", "vectors", "coords"])

        def drain(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held)
            key = list(zip(t.column("label").to_pylist(), t.column("d").to_pylist(), strict=True))
            at = 0
            while at < len(t):
                end = at
                while end < len(t) and end - at < BLOCK and key[end] == key[at]:
                    end += 1
                if end == len(t) and not last and end - at < BLOCK:
                    break
                yield emit(t.slice(at, end - at))
                at = end
            held = t.slice(at).to_batches()

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(len(h) for h in held) >= 2 * BLOCK:
                yield from drain(False)
        if held:
            yield from drain(True)

    label_type = unique.schema["label"].dataType.simpleString()
    blocks = scratch.keep(ordered.select("label", "rep", "times", "v", "d", "y").mapInArrow(cut, f"block long, label {label_type}, d int, lo array<double>, hi array<double>, reps binary, times binary, vectors binary, coords binary"), "blocks")
    # boxes only: pairs of blocks that share a cell of the first direction (or neighbour it) and aren't provably distant
    box = blocks.select("block", "label", "d", "lo", "hi")
    width = F.lit(max(epsilon, 1e-6))
    first = lambda c, by: (F.floor((F.element_at(c, 1)) / width) + by).cast("int")
    mine = box.select(F.col("block").alias("a"), "label", "d", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(first(F.col("lo"), 0), first(F.col("hi"), 0))).alias("c"))
    other = box.select(F.col("block").alias("b"), "label", "d", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(first(F.col("lo"), -1), first(F.col("hi"), 1))).alias("c"))
    gaps = F.transform(F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"), lambda z: F.greatest(F.lit(0.0), z["lo_a"] - z["hi_b"], z["lo_b"] - z["hi_a"]))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon**2 + SLACK
    pairs = mine.join(other, ["label", "d", "c"]).filter((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()
    blob = ["reps", "times", "vectors", "coords"]
    work = pairs.join(blocks.select(F.col("block").alias("a"), "d", *[F.col(c).alias(f"a_{c}") for c in blob]), "a").join(blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"b_{c}") for c in blob]), "b")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                def side(p: str) -> tuple:
                    u = np.frombuffer(r[f"{p}_vectors"], kind).reshape(-1, r["d"]).astype(np.float64)
                    u = u / np.linalg.norm(u, axis=1, keepdims=True)
                    return u, np.frombuffer(r[f"{p}_coords"]).reshape(len(u), -1)

                same = r["a"] == r["b"]
                one, two = side("a"), side("b")
                x, y = _join_blocks(one, two, same, cosine, epsilon)
                if not len(x):
                    continue
                reps = [np.frombuffer(r["a_reps"], np.int64)] + ([] if same else [np.frombuffer(r["b_reps"], np.int64)])
                times = [np.frombuffer(r["a_times"], np.int64)] + ([] if same else [np.frombuffer(r["b_times"], np.int64)])
                reps, times = np.concatenate(reps), np.concatenate(times)
                y = y if same else y + len(one[0])
                links = np.bincount(x, weights=times[y], minlength=len(reps)) + np.bincount(y, weights=times[x], minlength=len(reps))
                root = _roots(len(reps), x, y)
                at = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(links[at].astype(np.int64)), pa.array(reps[root[at]])], ["rep", "links", "root"])

    found = scratch.keep(work.mapInArrow(join, "rep long, links long, root long"), "found")
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # a copy's other copies are links as well
    classes = unique.drop("v").join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select(*group, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    out = keyed.drop("v").join(classes, [*group, "ok"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _schema(df: DataFrame, keep: list[str], extra: str):
    return T.StructType([*[df.schema[c] for c in keep], *T._parse_datatype_string(extra).fields])
