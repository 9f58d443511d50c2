"""Packing of token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. How full the bins can get depends on the pieces' lengths alone,
so the packing is solved on the histogram of lengths (``capacity`` numbers, whatever the corpus holds): per bin a bitset
subset-sum over the lengths still there finds the fullest feasible combination, which is removed as often as the
histogram holds it. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import spread
from .common import Scratch, buckets_for, gather, ranked, small_batches, text_slices, tidy
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's index, piece, start, length): a longer document's last pieces are full, its first takes the rest."""
    count = np.maximum(1, -(-sizes // capacity))
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = sizes - (count - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids and then ``end_id``."""
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes)
    out = np.full(int(sizes.sum()), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, np.concatenate([[0], ends])


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, without its ids: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids, at = with_end(*encode(data, offsets), end_id)
                doc, piece, start, length = cut_pieces(np.diff(at), capacity)
                raw, lo = memoryview(ids.astype("<u4").view(np.uint8)), (at[doc] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(lo.tolist(), (lo + length * 4).tolist(), strict=True)), np.int64, len(lo))
                key = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([key, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(tidy(pieces), PIECES)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination of the lengths in ``counts`` that fills ``room`` best; longest lengths are tried first."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, reach))
        left, width = min(counts[length], room // length), 1
        while left:  # bounded copies by doubling: 1, 2, 4, ... and the rest
            take = min(width, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            width *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        copies = 0
        while not before >> at & 1:
            at -= length
            copies += 1
        if copies:
            used.append((length, copies))
    return used


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until every piece has a place. The longest length left opens a bin."""
    counts = {k: v for k, v in histogram.items() if v}
    plan = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        rest = fullest(counts, capacity - top)
        counts[top] += 1
        need: dict[int, int] = {top: 1}
        for length, copies in rest:
            need[length] = need.get(length, 0) + copies
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        plan.append(([x for x, n in sorted(need.items(), reverse=True) for _ in range(n)], times))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that a bin's position takes: sorted by (length, first rank)."""
    rows, taken, base = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), base, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        base += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols, strict=True))


#: Above any rank within one length.
RANKS = 1 << 44


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each row of ``docs`` lies in sequences of at most ``capacity`` tokens.

    Null and empty texts are one token, ``end_id``. Rows without id and repeated rows are packed each. Pieces of one
    length take places in the order of (doc_id, piece, ids_crc32), so ties between equal rows decide nothing else. A
    text of any length is encoded whole and cut. An empty table gives an empty result. Only the id and text columns
    are read. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.keep(document_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = _places(solve(histogram, capacity))
    key = places["length"] * RANKS + places["first"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {n: batch.column(n) for n in batch.schema.names}
            length, rank = (held[n].to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            at = np.searchsorted(key, length * RANKS + rank, side="right") - 1
            held["sequence_id"] = pa.array(places["sequence"][at] + rank - places["first"][at])
            held["offset"] = pa.array(places["offset"][at])
            del held["_rank"]
            yield pa.RecordBatch.from_pydict(held)

    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    # a hot length holds a third of the rows at most of tasks of BUCKET_ROWS
    placed = ranked(pieces, ["length"], order, buckets_for(max(histogram.values(), default=0)), "_rank")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(seat, PIECES + ", sequence_id long, offset long")


# --- packed id matrices -------------------------------------------------------------------------------------------


class CapacityTree:
    """Bins by room left, in a segment tree over the rooms 0 to capacity: the least room of at least so much, in log steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length() if capacity else 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The (room, bin) with the smallest room that holds ``least``, taken out; None if no bin does."""
        at, count = self.leaves + least, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a sibling to the right has bins
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins: longest first, each into the fullest bin that holds it."""
    tree, bins = CapacityTree(capacity), 0
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        room, b = found if found else (capacity, bins)
        bins += not found
        bin_of[i], offset[i] = b, capacity - room
        tree.put(room - size, b)
    return bin_of, offset, bins


PACKED = "sequence_id long, n_tokens int, n_segments int, id_bytes int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


def packed_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, window_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of packed id matrices, ready to be written: one of ``capacity`` ids a sequence.

    ``ids`` and ``position_ids`` are little-endian unsigned integers of ``id_bytes`` bytes: two if the capacity and every id
    of the vocabulary fit, else four, alike in all rows; past ``n_tokens`` ids are ``pad_id`` and positions 0. Segments are pieces of documents: ``cu_seqlens`` has
    their bounds, positions start anew at each, and (doc_ids, pieces, starts) tell where each comes from, so the
    documents can be put together again without loss. Every task packs what it reads in windows of about
    ``window_tokens``: no shuffle, bounded memory, at most one poorly filled sequence a window. Null and empty texts
    are ``end_id`` alone; a null id stays null; pieces of one length keep the order they are read in; repeated rows are
    packed each; an empty table gives no row. Other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        held_encoder = encoder(tokenizer_path)
        encode, wide = held_encoder.encode, max(end_id, pad_id, capacity, held_encoder.largest) > 0xFFFF
        held: list[tuple] = []
        tokens = done = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, done
            if not held:
                return
            ids = np.concatenate([h[0] for h in held])
            doc = pa.concat_arrays([h[1] for h in held])
            piece, start, length = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            begin = np.cumsum(length) - length
            bin_of, offset, bins = best_fit_decreasing(length, capacity)
            order = np.lexsort((offset, bin_of))
            kind = "<u4" if wide else "<u2"
            matrix = np.full(bins * capacity, pad_id, kind)
            places = np.zeros(bins * capacity, kind)
            to = gather(bin_of * capacity + offset, length)
            matrix[to] = ids[gather(begin, length)]
            places[to] = gather(np.zeros(len(length), np.int64), length)
            segments = np.bincount(bin_of, minlength=bins)
            fill = np.bincount(bin_of, weights=length, minlength=bins).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(segments)])
            # bounds: each sequence's offsets and, last, its fill
            bounds = np.insert(offset[order], cuts[1:], fill)
            for a in range(0, bins, 256):
                b = min(bins, a + 256)
                at = order[cuts[a] : cuts[b]]
                listed = pa.array(cuts[a : b + 1] - cuts[a], pa.int32())
                limits = pa.array(cuts[a : b + 1] - cuts[a] + np.arange(b - a + 1), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + done + np.arange(a, b)),
                        pa.array(fill[a:b], pa.int32()),
                        pa.array(segments[a:b], pa.int32()),
                        pa.array([4 if wide else 2] * (b - a), pa.int32()),
                        pa.ListArray.from_arrays(listed, doc.take(pa.array(at))),
                        pa.ListArray.from_arrays(listed, pa.array(piece[at], pa.int32())),
                        pa.ListArray.from_arrays(listed, pa.array(start[at], pa.int64())),
                        pa.ListArray.from_arrays(limits, pa.array(bounds[cuts[a] + a : cuts[b] + b], pa.int32())),
                        pa.array([matrix[i * capacity : (i + 1) * capacity].tobytes() for i in range(a, b)], pa.binary()),
                        pa.array([places[i * capacity : (i + 1) * capacity].tobytes() for i in range(a, b)], pa.binary()),
                    ],
                    ["sequence_id", "n_tokens", "n_segments", "id_bytes", "doc_ids", "pieces", "starts", "cu_seqlens", "ids", "position_ids"],
                )
            held, tokens, done = [], 0, done + bins

        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids, at = with_end(*encode(data, offsets), end_id)
                doc, piece, start, length = cut_pieces(np.diff(at), capacity)
                held.append((ids, batch.column(0).slice(a, b - a).take(pa.array(doc)), piece, start, length))
                tokens += len(ids)
                if tokens >= window_tokens:
                    yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(tidy(pack), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the matrices as Parquet, wherever Spark can write."""
    packed.write.mode("overwrite").parquet(path)


def unpack(rows, capacity: int) -> dict[int, list[int]]:
    """Documents' ids from collected rows of packed_matrices; for tests and small readers."""
    parts: dict[int, list[tuple[int, list[int]]]] = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), f"<u{r['id_bytes']}")
        for k, doc in enumerate(r["doc_ids"]):
            parts.setdefault(doc, []).append((r["starts"][k], ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()))
    return {d: [i for _, x in sorted(p) for i in x] for d, p in parts.items()}
