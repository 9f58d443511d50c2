"""Jaccard join on word shingles by an R-tree over count vectors.

Shingles are hashed into groups, and a set is the point of its group counts; the overlap of two sets is at most the sum
of the minima of their coordinates. The tree's entries are leading groups of the finest grain: in one order of all
groups (frequent ones last), two sets whose leading groups have none in common can't reach the overlap asked for, as the
minima of the remaining coordinates sum up to too little. Below an entry stands a packed R-tree for each band of sizes,
whose nodes keep coordinate maxima and size ranges, and a search follows the nodes whose sum of minima may suffice.

The search runs twice. On points alone it leaves blocks: sets that a chain of possible partners joins. Each set then
goes to its one block, where the tree is searched again and what survives the bound is verified on the sets. Every link
comes out of a tree; no pair is listed before its bound has passed.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import spread
from .common import Scratch, gather, mix, run_hashes, small_batches, text_slices, tidy
from .graph import components

log = logging.getLogger(__name__)

#: Members of a group that one task searches at once, and their shingles; larger groups are searched in parts.
CELL = 2000
CELL_SHINGLES = 4_000_000
FAN_OUT = 16
#: Groups of a point at least.
GROUPS = 32
#: Numbers that are broadcast at most: some 16 MB in an executor.
BROADCAST_ROWS = 500_000
#: Bytes of text that are shingled at once: a few hundred bytes of memory each.
SLICE = 1 << 19
#: Frequent shingles that stand last in the order of groups, at most; those that a task keeps count of; rows from which one counts.
FREQUENT, TASK_FREQUENT, FREQUENT_ROWS = 200_000, 1 << 15, 32
#: Rows of one entry that one task takes at most, where its count is known; documents of one set that one task joins.
HOT_ROWS = 100_000


def point_groups(size: np.ndarray) -> np.ndarray:
    """Groups of a point, a power of two that grows with the set, so that a group holds two to four shingles.

    The minima of unrelated counts of about three sum up to two thirds of a set, well below what a similarity of 0.8
    asks for (0.89); with twelve a group it would be 0.84, and many pairs would pass that aren't similar.
    """
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(size / 4, 1))).astype(np.int64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each text's distinct shingles, sorted. A-Z are lower-cased; words are runs of bytes that are no ASCII white space."""
    n = len(offsets) - 1
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin = ~white
    if len(data):
        begin[1:] &= white[:-1]
        begin[heads] = ~white[heads]
    starts = np.flatnonzero(begin)
    edge = white.copy()
    edge[heads] = True
    stops = np.append(np.flatnonzero(edge), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    word = run_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), made)
    at = gather(first[:-1], made)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            inside = k < np.minimum(count, words)[doc]
            step = value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
            value = np.where(inside, step + word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else step, value)
        value = mix(value + np.minimum(count, words)[doc].astype(np.uint64))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(n + 1))


def set_ids(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each set: equal sets have equal ones."""
    sums = np.zeros(len(value) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(value ^ np.uint64(0x51)), out=sums[1:])
        return mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ mix(np.diff(offsets).astype(np.uint64))).view(np.int64)


def points(value: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each set's group counts, a byte each; groups are the leading bits of the hash, so halving their number adds neighbours up.

    Groups hold four shingles at most on average, by a hash: none comes near the 255 that a byte holds.
    """
    size = np.diff(offsets)
    groups = point_groups(size)
    base = np.cumsum(groups) - groups
    shift = (64 - np.log2(groups).astype(np.int64)).astype(np.uint64)
    doc = np.repeat(np.arange(len(size)), size)
    at = base[doc] + (value >> shift[doc]).astype(np.int64)
    flat = np.bincount(at, minlength=int(groups.sum())).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(base, groups.sum()).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


class Frequent:
    """Shingles that many sets hold, counted in bounded memory: beyond ``most`` of them all counts sink by that of the next one."""

    def __init__(self, most: int):
        self.most, self.kept = most, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, value: np.ndarray) -> None:
        found, count = np.unique(value, return_counts=True)
        more = count > 1
        self.new.append((found[more], count[more]))
        if sum(len(f) for f, _ in self.new) > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        every, count = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        found, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, weights=count, minlength=len(found)).astype(np.int64)
        if len(found) > self.most:
            total -= np.partition(total, -self.most - 1)[-self.most - 1]
            found, total = found[total > 0], total[total > 0]
        self.kept, self.new = (found, total), []
        return self.kept


def entries(value: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, shingle, whether the smaller of a pair may enter by it) for the leading groups by which a set may meet a similar one.

    Groups are ordered by their hash, but those in ``frequent`` (sorted) stand last.

    Of two similar sets the larger has one of the shared shingles among its first |x| - ceil(t |x|) + 1, the smaller
    (or equal) among its first |y| - ceil(2t/(1+t) |y|) + 1.
    """
    size = np.diff(offsets)
    up, down = similarity.numerator, similarity.denominator
    probe = size - (up * size + down - 1) // down + 1
    twice = 2 * similarity / (1 + similarity)
    index = size - (twice.numerator * size + twice.denominator - 1) // twice.denominator + 1
    # sets this small are similar only if equal
    alone = (down - up) * (size + size * down // up) // (down + up) < 1
    probe = np.where(alone, 0, probe)
    doc = np.repeat(np.arange(len(size)), size)
    last = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value if len(frequent) else np.zeros(len(value), bool)
    plain = np.cumsum(~last)
    before = np.concatenate([[0], plain])[offsets[:-1]]
    plain_of = np.concatenate([[0], plain])[offsets[1:]] - before
    rank = plain - 1 - before[doc]
    here = np.flatnonzero(last)
    owner = doc[here]
    rank[here] = plain_of[owner] + (here - offsets[:-1][owner]) - (plain[here] - before[owner])
    take = np.flatnonzero(rank < probe[doc])
    return doc[take], value[take], rank[take] < index[doc[take]]


def _partnered(key: np.ndarray, size: np.ndarray, enters: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Which rows of sorted (entry, size) have a partner of a fitting size under the same entry, one of both entering as the smaller one."""
    up, down = similarity.numerator, similarity.denominator
    group = np.zeros(len(key), np.int64)
    group[1:] = np.cumsum(key[1:] != key[:-1])
    place = group << 32 | size
    low = np.searchsorted(place, group << 32 | (up * size + down - 1) // down)
    high = np.searchsorted(place, place, side="right")
    sums = np.concatenate([[0], np.cumsum(enters)])
    smaller = sums[high] - sums[low] - enters > 0
    larger = np.searchsorted(place, group << 32 | size * down // up, side="right") - np.searchsorted(place, place) > 1
    return smaller | (enters & larger)


def fold(flat: np.ndarray, start: np.ndarray, groups: np.ndarray, rows: np.ndarray, to: int) -> np.ndarray:
    """The points of ``rows`` with ``to`` groups, which none of them has less of."""
    out = np.empty((len(rows), to), np.uint16)
    for g in np.unique(groups[rows]).tolist():
        here = np.flatnonzero(groups[rows] == g)
        held = flat[start[rows[here]][:, None] + np.arange(g)]
        out[here] = held if g == to else held.reshape(len(here), to, -1).sum(2, dtype=np.uint16)
    return out


class CountTree:
    """R-tree over points, packed along the coordinate of most variance at each level; nodes keep coordinate maxima and size ranges."""

    def __init__(self, points_: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points_)
        p, s = points_[self.order], sizes[self.order]
        self.levels = [(p, s, s)]
        while len(p) > 1:
            cut = np.arange(0, len(p), FAN_OUT)
            lo, hi = self.levels[-1][1], self.levels[-1][2]
            p = np.maximum.reduceat(p, cut, axis=0)
            self.levels.append((p, np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    @staticmethod
    def _pack(p: np.ndarray) -> np.ndarray:
        out, stack = [], [np.arange(len(p))]
        while stack:
            rows = stack.pop()
            if len(rows) <= FAN_OUT:
                out.append(rows)
                continue
            spread = p[rows].var(0)
            rows = rows[np.argsort(p[rows, spread.argmax()], kind="stable")]
            half = -(-len(rows) // (2 * FAN_OUT)) * FAN_OUT
            stack.append(rows[half:])
            stack.append(rows[:half])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, point: np.ndarray, size: int, t: float) -> np.ndarray:
        """Rows whose overlap with the point may reach t/(1+t) of both sizes: sum of minima against each node's maxima."""
        at = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            p, lo, hi = self.levels[level]
            if level < len(self.levels) - 1:
                at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                at = at[at < len(p)]
            fits = (hi[at] >= t * size - 1e-9) & (lo[at] <= size / t + 1e-9)
            at = at[fits]
            least = np.maximum(lo[at], t * size)
            bound = np.minimum(p[at], point).sum(1, dtype=np.int64)
            at = at[bound >= t / (1 + t) * (size + least) - 1e-6]
            if not len(at):
                break
        return self.order[at]


class Forest:
    """The trees of one group of members, one for each band of sizes (points of one number of groups)."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, groups: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        self.flat, self.start, self.groups, self.sizes = flat, start, groups, sizes
        self.bands = {int(g): rows[groups[rows] == g] for g in np.unique(groups[rows])}
        self.range = {g: (sizes[r].min(), sizes[r].max()) for g, r in self.bands.items()}
        self.trees: dict[tuple[int, int], CountTree] = {}

    def search(self, row: int, t: float) -> np.ndarray:
        size, own = int(self.sizes[row]), int(self.groups[row])
        out = []
        for g, rows in self.bands.items():
            low, high = self.range[g]
            if high < t * size - 1e-9 or low > size / t + 1e-9:
                continue
            to = min(g, own)
            if (g, to) not in self.trees:
                self.trees[g, to] = CountTree(fold(self.flat, self.start, self.groups, rows, to), self.sizes[rows])
            point = fold(self.flat, self.start, self.groups, np.array([row]), to)[0]
            out.append(rows[self.trees[g, to].search(point, size, t)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class Roots:
    """Which members are joined, within each group: labels that were known before, and the links found since."""

    def __init__(self, group: np.ndarray, label: np.ndarray):
        order = np.lexsort((label, group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        self.at, self.up = at.tolist(), list(range(int(new.sum())))

    def __call__(self, row: int) -> int:
        x = self.at[row]
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self(b)] = self(a)


#: Pairs of a leaf whose points are compared at once, times groups.
LEAF_WORK = 1 << 19


def leaf_pairs(cuts: np.ndarray, flat: np.ndarray, start: np.ndarray, groups: np.ndarray, sizes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): pairs of rows of one group (of FAN_OUT rows at most: a tree of a single leaf) that pass the bound, all groups at once."""
    count = np.diff(cuts)
    row = np.arange(cuts[0], cuts[-1])
    after = np.repeat(cuts[1:], count) - row - 1
    a = np.repeat(row, after)
    b = gather(row + 1, after)
    fits = np.minimum(sizes[a], sizes[b]) >= t * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[fits], b[fits]
    to = np.minimum(groups[a], groups[b])
    passed = np.zeros(len(a), bool)
    for g in np.unique(to).tolist():
        here = np.flatnonzero(to == g)
        step = max(1, LEAF_WORK // g)
        for i in range(0, len(here), step):
            part = here[i : i + step]
            bound = np.minimum(fold(flat, start, groups, a[part], g), fold(flat, start, groups, b[part], g)).sum(1, dtype=np.int64)
            passed[part] = bound >= t / (1 + t) * (sizes[a[part]] + sizes[b[part]]) - 1e-6
    return a[passed], b[passed]


def _linked(x: np.ndarray, y: np.ndarray, similarity: Fraction) -> bool:
    """Whether two sorted sets are as similar as asked for."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared * similarity.denominator >= similarity.numerator * (len(x) + len(y) - shared)


def search_groups(cuts: np.ndarray, whole: np.ndarray, sid: np.ndarray, label: np.ndarray, side: np.ndarray, sizes: np.ndarray, flat: np.ndarray, start: np.ndarray, sets, similarity: Fraction) -> list[tuple[int, int]]:
    """Links that join members of each group, enough of them to span all that the group's pairs join.

    ``side`` says whether a row is a target (1), a query (2) or both (3); a ``whole`` group has all its members here.
    Without ``sets`` a pair that passes the bound is a link; with them it must be as similar as asked for.
    """
    t = float(similarity)
    groups = np.diff(np.append(start, len(flat))) if len(start) else start
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    root = Roots(of, label)
    out: list[tuple[int, int]] = []

    def meet(a: int, b: int) -> None:
        if root(a) != root(b) and (sets is None or _linked(sets(a), sets(b), similarity)):
            out.append((int(sid[a]), int(sid[b])))
            root.join(a, b)

    small = np.diff(cuts) <= FAN_OUT
    if small.any():
        rows = np.flatnonzero(small[of])
        inner = np.concatenate([[0], np.cumsum(np.diff(cuts)[small])])
        a, b = leaf_pairs(inner, flat, start[rows], groups[rows], sizes[rows], t)
        a, b = rows[a], rows[b]
        apart = ((side[a] & 1 > 0) & (side[b] & 2 > 0)) | ((side[a] & 2 > 0) & (side[b] & 1 > 0))
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            meet(x, y)
    for k in np.flatnonzero(~small).tolist():
        rows = np.arange(cuts[k], cuts[k + 1])
        forest = Forest(flat, start, groups, sizes, rows[side[rows] & 1 > 0])
        queries, big = rows[side[rows] & 2 > 0].tolist(), None
        # where all of a group is here every pair is searched from either end, so members of one component need not ask:
        # that of the first three members that holds most
        for i, q in enumerate(queries):
            if whole[k] and i == 3:
                held = [root(r) for r in rows.tolist()]
                big = max(queries[:3], key=lambda r: held.count(root(r)))
            if big is not None and root(q) == root(big):
                continue
            for r in forest.search(q, t).tolist():
                if r != q:
                    meet(q, r)
    return out


def jaccard_groups(docs: DataFrame, words: int = 3, similarity: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Sets are the distinct shingles of ``words`` words of whole texts; with fewer words the sequence is the one shingle;
    null, empty and blank texts have none and link with nothing. Rows link when their sets' Jaccard similarity is at
    least ``similarity``; component_id is the smallest doc_id reachable. Equal sets are one set in the search. Rows of
    one doc_id are one document: what any of its texts links with is linked. Rows without a doc_id link like others and
    get the component of their set, null if no row of it has an id. An empty table gives an empty result; other columns
    are not read. A very long text is a set like any other: memory grows with the text, some 60 bytes a byte.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    small_batches(docs.sparkSession)
    named = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, frequent = ["doc_id", "n", "sid", "point", "rows"], Frequent(TASK_FREQUENT)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                value, at = shingle_sets(data, offsets, words)
                frequent.add(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.array(set_ids(value, at)), points(value, at), pa.nulls(b - a, pa.int64())], names)
        found, rows = frequent.settle() if frequent.new or len(frequent.kept[0]) else frequent.kept
        keep = rows >= 4
        m = int(keep.sum())
        if m:
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(found[keep].view(np.int64)), pa.nulls(m, pa.binary()), pa.array(rows[keep])], names)

    both = scratch.keep(named.mapInArrow(tidy(read), "doc_id long, n long, sid long, point binary, rows long"), "sets")
    known = both.filter("rows IS NULL").select("doc_id", "n", "sid", "point")
    often = both.filter("rows IS NOT NULL").groupBy("sid").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= FREQUENT_ROWS)
    often = often.orderBy(F.desc("rows"), "sid").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    key, rows = often.column("sid").to_numpy(), often.column("rows").to_numpy()
    last = np.sort(key.view(np.uint64))
    hot = np.flatnonzero(rows > HOT_ROWS)
    hot = hot[np.argsort(key[hot])]
    hot_key, hot_parts = key[hot], (rows[hot] // HOT_ROWS + 1).astype(np.int64)

    # rows (entry, set, size): what enters the tree where
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE):
                value, at = shingle_sets(data, offsets, words)
                sid = set_ids(value, at)
                doc, key, smaller = entries(value, at, last, similarity)
                fresh = np.zeros(len(sid), bool)
                for i, s in enumerate(sid.tolist()):  # copies of one set that a task meets enter once
                    if s not in seen:
                        fresh[i] = True
                        seen.add(s)
                if len(seen) > 100_000:
                    seen.clear()
                take = fresh[doc]
                doc, key, smaller = doc[take], key[take].view(np.int64), smaller[take]
                salt = np.zeros(len(key), np.int64)
                if len(hot_key) and len(key):
                    spot = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                    salt = np.where(hot_key[spot] == key, 1 + (sid[doc] & np.int64(0x7FFFFFFF)) % hot_parts[spot], 0)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt.astype(np.int32)), pa.array(sid[doc]), pa.array(np.diff(at)[doc] << 1 | smaller)], ["g", "salt", "sid", "m"])

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries by which sets of fitting sizes enter; rows come sorted. Rows of an entry that is larger than what is held at once all pass."""
        held: list[pa.RecordBatch] = []
        long: int | None = None

        def run(end: bool) -> pa.RecordBatch:
            nonlocal held, long
            tab = pa.Table.from_batches(held)
            g, salt, sid, m = (tab.column(c).to_numpy() for c in range(4))
            single = g[0] == g[-1]
            upto = len(g) if end or single else int(np.searchsorted(g, g[-1]))
            held = tab.slice(upto).to_batches()
            if single and not end:
                long = int(g[0])
            g, salt, sid, m = g[:upto], salt[:upto], sid[:upto], m[:upto]
            new = np.ones(upto, bool)
            new[1:] = (g[1:] != g[:-1]) | (sid[1:] != sid[:-1])
            g, salt, sid, m = g[new], salt[new], sid[new], m[new]
            keep = _partnered(g, m >> 1, (m & 1) > 0, similarity) | (salt > 0)
            if long is not None:
                keep |= g == long
            return pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(sid[keep]), pa.array(m[keep] >> 1)], ["g", "sid", "n"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                if sum(map(len, held)) >= 50_000:
                    yield run(False)
        if sum(map(len, held)):
            yield run(True)

    listed = named.select("_text").mapInArrow(tidy(enter), "g long, salt int, sid long, m long")
    listed = listed.repartition("g", "salt").sortWithinPartitions("g", "m", "sid")
    shared = scratch.keep(listed.mapInArrow(tidy(partnered), "g long, sid long, n long"), "entries")

    # blocks: what the bound on points joins. First by two entries of each set, so that groups of near copies are one
    # block before their many other entries are looked at
    member = known.join(_small(scratch.keep(shared.select("sid").distinct(), "taking")), "sid", "left_semi").select("sid", "n", "point")
    member = scratch.keep(member.groupBy("sid").agg(F.first("n").alias("n"), F.first("point").alias("point")), "members")
    two = shared.groupBy("sid").agg(F.first("n").alias("n"), F.min("g").alias("g1"), F.max("g").alias("g2"))
    two = two.select(F.explode(F.array_distinct(F.array("g1", "g2"))).alias("g"), "sid", "n")
    first = scratch.keep(_trees(two.withColumn("label", F.col("sid")), member, similarity, False, scratch), "chains")
    label = _labels([first], scratch)
    rest = _distinct_groups(_labelled(shared, label), scratch)
    more = scratch.keep(_trees(rest, member, similarity, True, scratch), "chains")
    block = _labels([first, more], scratch)

    # links: in each block the tree again, now with the sets themselves
    block = block.withColumnRenamed("label", "g")
    blocked = scratch.keep(member.select("sid", "n").join(block, "sid").select("g", "sid", "n"), "blocks")
    reps = scratch.keep(known.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "reps")
    taking = scratch.keep(blocked.select("sid").join(reps, "sid").select("sid", F.coalesce("rep", F.lit(-1 << 63)).alias("_key")), "taking")

    def held_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE):
                value, at = shingle_sets(data, offsets, words)
                sets = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(value, at)), pa.array(np.diff(at).astype(np.int64)), points(value, at), sets.cast(pa.binary())], ["sid", "n", "point", "shingles"])

    keyed = named.withColumn("_key", F.coalesce("doc_id", F.lit(-1 << 63)))
    texts = keyed.join(_small(taking.select("_key").distinct()), "_key", "left_semi").select("_text")
    sets = texts.mapInArrow(tidy(held_sets), "sid long, n long, point binary, shingles binary")
    if not known.groupBy("doc_id").count().filter("count > 1").isEmpty():  # repeated rows: one of each set
        sets = sets.dropDuplicates(["sid"])
    near = scratch.keep(_trees(blocked.withColumn("label", F.col("sid")), sets, similarity, False, scratch), "links")
    label = _labels([near], scratch)
    far = scratch.keep(_trees(_labelled(blocked, label), sets, similarity, True, scratch), "links")
    log.info("chains from two entries %d, from the others %d; links in blocks %d, across parts and components %d", *(x.count() for x in (first, more, near, far)))

    # components by documents: a set is named by its smallest doc_id, and a document with several sets joins them
    links = near.unionByName(far)
    ids = reps.select("sid", "rep")
    links = links.join(ids.withColumnsRenamed({"sid": "a", "rep": "ra"}), "a").join(ids.withColumnsRenamed({"sid": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    several = known.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("doc_id")
    own = known.filter("n > 0").join(several, "doc_id").select(F.col("doc_id").alias("a"), "sid").join(ids, "sid").select("a", F.col("rep").alias("b")).distinct()
    links = links.filter("a IS NOT NULL AND b IS NOT NULL").unionByName(own)
    label = components(links, scratch).select(F.col("node").alias("rep"), "component")
    classes = scratch.keep(reps.join(label, "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"), "c"), "classes")
    return _attach(known.select("doc_id", "n", "sid"), classes)


def _attach(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Each document with its set's component. Sets with very many documents (few, as each takes so many) are broadcast, so their documents needn't meet."""
    hot = F.broadcast(classes.filter(F.col("c") > HOT_ROWS).orderBy(F.desc("c")).limit(BROADCAST_ROWS).select("sid", F.col("component").alias("_hot"), F.lit(True).alias("_is")))
    out = known.join(hot, "sid", "left")
    cold = classes.select(F.col("sid").alias("_sid"), "component", F.lit(False).alias("_other"))
    # a document of a hot set, or of none, looks for nothing: its key is spread and its flag meets no row
    out = out.withColumn("_flag", F.coalesce("_is", F.col("n") == 0)).withColumn("_key", F.when(F.col("_flag"), F.xxhash64("doc_id")).otherwise(F.col("sid")))
    out = out.join(cold, (F.col("_key") == F.col("_sid")) & (F.col("_flag") == F.col("_other")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("_hot", "component", "doc_id")).alias("component_id"))


def _small(ids: DataFrame) -> DataFrame:
    """A written table of single numbers, marked for a broadcast if it has BROADCAST_ROWS at most; else Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _labels(links: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(sid, label) of the sets that links join."""
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return scratch.keep(components(every, scratch).select(F.col("node").alias("sid"), F.col("component").alias("label")), "labels")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (g, sid, n, label) of the groups that hold more than one component."""
    here = rows.join(label, "sid", "left").select("g", "sid", "n", F.coalesce("label", "sid").alias("label"))
    open_ = here.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("g")
    return here.join(open_, "g", "left_semi")


def _distinct_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of groups with the same members one is enough. Members are compared by their number and two sums of their hashes."""
    rows = scratch.keep(rows, "open")
    hash_ = F.xxhash64("sid")
    halves = [F.sum(F.shiftrightunsigned(hash_, 32)).alias("s1"), F.sum(hash_.bitwiseAND(F.lit((1 << 32) - 1))).alias("s2")]
    chosen = rows.groupBy("g").agg(F.count("*").alias("c"), *halves).groupBy("c", "s1", "s2").agg(F.min("g").alias("g")).select("g")
    return rows.join(chosen, "g", "left_semi")


def _trees(groups: DataFrame, member: DataFrame, similarity: Fraction, across: bool, scratch: Scratch) -> DataFrame:
    """(a, b): links that join members of each group of ``groups`` (g, sid, n, label), by a search in the group's trees.

    ``member`` has each set's point, and the set itself if pairs are to be verified. Groups go to tasks in parts of CELL
    members and CELL_SHINGLES shingles at most. Without ``across`` a member meets its own part and one member of the
    group that all parts get: this joins most of a group of near copies. With it, every part is searched by every member
    outside the group's largest component, so no pair of members in different components is left out.
    """
    per = groups.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(F.xxhash64("sid").alias("h"), "sid")).alias("p"))
    parts = F.greatest(F.ceil(F.col("c") / CELL), F.ceil(F.col("s") / CELL_SHINGLES)).cast("int")
    per = per.filter("lo <> hi").select("g", parts.alias("parts"), F.col("p.sid").alias("pivot"))
    rows = groups.join(per, "g").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    single = F.col("parts") == 1
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    if not across:
        dealt = rows.withColumn("i", F.explode(F.when((F.col("sid") == F.col("pivot")) & ~single, every).otherwise(F.array("i"))))
        dealt = dealt.select("g", "i", F.lit(0).alias("j"), F.lit(3).alias("side"), "sid", "label")
    else:
        whole = rows.filter(single).select("g", "i", F.lit(0).alias("j"), F.lit(3).alias("side"), "sid", "label")
        large = rows.filter(~single)
        most = large.groupBy("g", "label").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "label")).alias("most")).select("g", F.col("most.label").alias("most"))
        large = large.join(most, "g").withColumn("out", F.col("label") != F.col("most"))
        asking = large.filter("out").groupBy("g").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("askers"))
        large = large.join(asking, "g")
        targets = large.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).select("g", "i", "j", F.lit(1).alias("side"), "sid", "label")
        queries = large.filter("out").withColumn("j", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("askers")).cast("int")).withColumn("i", F.explode(every))
        dealt = whole.unionByName(targets).unionByName(queries.select("g", "i", "j", F.lit(2).alias("side"), "sid", "label"))
    has_sets = "shingles" in member.columns
    dealt = scratch.keep(dealt, "dealt")
    count = dealt.count()
    if not count:
        return dealt.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    dealt = (F.broadcast(dealt) if count <= BROADCAST_ROWS // 4 else dealt).join(member, "sid")
    names = ["g", "i", "j", "side", "sid", "label", "n", "point"] + (["shingles"] if has_sets else [])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of a batch together, as rows come sorted; the last may go on in the next."""
        held: list[pa.RecordBatch] = []

        def run(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            tab = pa.Table.from_batches(held)
            g, i, j, side, sid, label, n = (tab.column(c).to_numpy() for c in names[:7])
            edge = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cuts = np.concatenate([[0], edge, [len(g)]])
            upto = len(cuts) - 1 if end else len(cuts) - 2
            held = [] if end else tab.slice(int(cuts[upto])).to_batches()
            if not upto:
                return
            cuts = cuts[: upto + 1]
            m = int(cuts[-1])
            flat, start = _bytes_of(tab.column("point").slice(0, m))
            sets = None
            if has_sets:
                raw, at = _bytes_of(tab.column("shingles").slice(0, m))
                to = np.append(at[1:], len(raw))
                sets = lambda r: np.frombuffer(raw[at[r] : to[r]].tobytes(), np.uint64)
            whole = np.logical_and.reduceat(side[:m] == 3, cuts[:-1])
            out = search_groups(cuts, whole, sid[:m], label[:m], side[:m], n[:m], flat, start, sets, similarity)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                if sum(map(len, held)) >= 5_000 or sum(b.nbytes for b in held) > 1 << 24:
                    yield from run(False)
        if held:
            yield from run(True)

    order = ["g", "i", "j", "sid"]
    return dealt.select(*names).repartition("g", "i", "j").sortWithinPartitions(*order).mapInArrow(tidy(search), "a long, b long")


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values, one after the other, and where each starts."""
    held = column.combine_chunks()
    held = (held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)).cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    flat = np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return flat, (offsets[:-1] - offsets[0]).astype(np.int64)
