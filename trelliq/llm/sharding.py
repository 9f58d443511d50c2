"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts on a hashed shard; in each round linked documents move
to the shard that holds most of their neighbours, as far as that shard's quota of rows admits them, and are held
there. Rounds go on until every linked document is held. At last every shard is filled to its quota exactly with the
rows that have no link.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, ranked

#: Groups above this part of a quota, and the last that wait, are placed one by one: so many a shard at most.
SINGLY = 64
#: Size classes of groups (powers of two, larger ones first) and lots within a class that a shard admits or refuses as one.
CLASSES, LOTS = 16, 32
GROUP = ["_h", "text_crc32", "size"]


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row of ``docs`` on a shard; law ``rows``: counts are at most one apart.

    Equal texts share a shard where the quotas allow it; a group larger than the room left is split over few shards.
    Neighbours have a say in the first ``rounds`` rounds, room alone in those after.
    A null text has no bytes (size 1, checksum 0) and no link; empty texts are equal texts. Repeated rows are rows of
    their own, each with a slot. An empty table gives an empty result. Other columns are neither read nor returned.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.col(text_col)
    # pmod of a hash of the id and the text: repeated rows of one id stay apart from other ids, and no row number is needed
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id",
        (F.coalesce(F.octet_length("_t"), F.lit(0)).cast("long") + 1).alias("size"),
        F.when(F.col("_t").isNull(), F.lit(0)).otherwise(F.crc32(F.col("_t").cast("binary"))).cast("long").alias("text_crc32"),
        F.xxhash64("_t").alias("_h"),
        F.col("_t").isNull().alias("_null"),
    )
    base = scratch.keep(base.withColumn("_spread", F.xxhash64("doc_id", "_h")), "base")
    rows = base.count()
    quota = _quotas(rows, shards)
    start = F.pmod(F.col("_spread"), F.lit(shards)).cast("int")

    # a group is held as a whole, so rounds see groups and their rows' first shards, never rows
    counts = base.filter(~F.col("_null")).groupBy(*GROUP, start.alias("_s")).agg(F.count("*").alias("_c"))
    groups = counts.groupBy(*GROUP).agg(F.sum("_c").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_s", "_c"))).alias("_votes"))
    groups = scratch.keep(groups.filter("_n > 1"), "groups")
    room = list(quota)
    large = F.col("_n") * SINGLY > max(quota)
    pieces = _singly(groups.filter(large).collect(), room)  # fewer than SINGLY a shard
    held, waiting = _rounds(groups.filter(~large), room, rounds, scratch)
    pieces += _singly(waiting.collect(), room)  # SINGLY a shard at most
    return _fill(_labelled(base, start, pieces, held, scratch), quota, rows, scratch)


def _singly(groups: Iterable[Row], room: list[int]) -> list[tuple]:
    """(group's key, shard, first row, row after the last) of each piece; largest groups first; takes the rows off ``room``.

    A group goes to the shard of most neighbours among those that hold it whole; where none does, to as few as hold it.
    """
    out = []
    for g in sorted(groups, key=lambda g: (-g["_n"], *(g[c] for c in GROUP))):
        key, n = [g[c] for c in GROUP], g["_n"]
        whole = [s for s in range(len(room)) if room[s] >= n]
        if whole:
            to = max(whole, key=lambda s: (g["_votes"].get(s, 0), room[s], -s))
            room[to] -= n
            out.append((*key, to, 0, n))
            continue
        seen = 0
        for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
            take = min(n - seen, room[s])
            if not take:
                break
            out.append((*key, s, seen, seen + take))
            seen, room[s] = seen + take, room[s] - take
    return out


def _rounds(waiting: DataFrame, room: list[int], rounds: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Groups held by rounds, with ``_label``, and the few that still wait; takes the held rows off ``room``.

    A group wishes for a shard with room for all of it: that of most neighbours, else any by a lot weighted by room. Who
    is admitted is decided by a histogram per shard, larger groups first; lots are drawn anew in each round. In rounds
    by room alone what is wished for of a shard is about its room at most, so each leaves few groups.
    """
    shards = len(room)
    left, number, voting = waiting.count(), 0, rounds > 0
    held: list[DataFrame] = []
    while left > SINGLY * shards:
        number += 1
        lot = lambda s: (F.pmod(F.xxhash64(F.lit(number), *GROUP, F.lit(s)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))  # noqa: B023,E731
        say = lambda s: F.coalesce(F.col("_votes")[s], F.lit(0)) if voting else F.lit(0)  # noqa: B023,E731
        wishes = [F.when(F.col("_n") <= room[s], F.struct(say(s).cast("long").alias("c"), (F.log(lot(s)) / max(1, room[s])).alias("w"), F.lit(s).alias("to"))) for s in range(shards)]
        size_class = F.least(F.floor(F.log2(F.col("_n").cast("double"))), F.lit(CLASSES - 1)).cast("int")
        wish = waiting.withColumn("_to", F.array_max(F.array(*wishes))["to"])
        wish = wish.withColumn("_class", F.lit(CLASSES - 1) - size_class).withColumn("_lot", F.pmod(F.xxhash64(F.lit(number), *GROUP), F.lit(LOTS)).cast("int"))
        wish = scratch.keep(wish, "wish")
        asked = wish.filter("_to is not null").groupBy("_to", "_class", "_lot").agg(F.sum("_n").alias("n"), F.count("*").alias("g")).collect()  # shards x CLASSES x LOTS rows at most
        admitted, before = [0] * (shards * CLASSES), left
        for r in sorted(asked, key=lambda r: (r["_to"], r["_class"], r["_lot"])):
            if r["n"] <= room[r["_to"]]:
                admitted[r["_to"] * CLASSES + r["_class"]] |= 1 << r["_lot"]
                room[r["_to"]] -= r["n"]
                left -= r["g"]
        word = F.element_at(F.array(*[F.lit(x).cast("long") for x in admitted]), F.col("_to") * CLASSES + F.col("_class") + 1)
        goes = F.coalesce(F.getbit(word, F.col("_lot")) == 1, F.lit(False))
        held.append(wish.filter(goes).select(*GROUP, F.col("_to").alias("_label")))
        waiting = wish.filter(~goes).select(*GROUP, "_n", "_votes")
        if not voting and left == before:  # not seen: the groups' rows are no more than all room, so some lot fits
            raise RuntimeError(f"sharding: {left} groups wait and no shard admits any")
        voting = voting and number < rounds and left * 2 <= before
    return held, waiting


def _labelled(base: DataFrame, start: Column, pieces: list[tuple], held: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Every row with its shard and whether it is held there."""
    columns = ["doc_id", *GROUP, "_spread"]
    parts = base.sparkSession.createDataFrame(pieces, "_h long, text_crc32 long, size long, _label int, _from long, _upto long")
    plan = parts.groupBy(*GROUP).agg(F.count("*").alias("_parts"), F.first("_label").alias("_planned"))
    known = base.filter(~F.col("_null")).join(F.broadcast(plan), GROUP, "left")
    whole = known.filter("_parts = 1").select(*columns, F.col("_planned").alias("_label"), F.lit(True).alias("_held"))
    out = whole
    if any(p[4] for p in pieces):  # rows of a group in pieces are numbered, so that each piece has its rows exactly
        most = max(p[5] for p in pieces)
        placed = ranked(known.filter("_parts > 1").select(*columns), GROUP, [F.col("doc_id"), F.col("_spread")], buckets_for(most), "_place")
        placed = placed.join(F.broadcast(parts), GROUP).filter("_place >= _from and _place < _upto")
        placed = placed.select(*columns, "_label", F.lit(True).alias("_held"))
        out = out.unionByName(placed)
    rest = known.filter("_parts is null").select(*columns)
    if held:
        found = held[0]
        for h in held[1:]:
            found = found.unionByName(h)
        rest = rest.join(found, GROUP, "left")
    else:
        rest = rest.withColumn("_label", F.lit(None).cast("int"))
    rest = rest.unionByName(base.filter("_null").select(*columns, F.lit(None).cast("int").alias("_label")))
    return out.unionByName(rest.select(*columns, F.coalesce("_label", start).alias("_label"), F.col("_label").isNotNull().alias("_held")))


def _fill(everyone: DataFrame, quota: list[int], rows: int, scratch: Scratch) -> DataFrame:
    """Keeps a shard's first rows up to its quota, held rows first, and deals the rest to the shards with room."""
    shards = len(quota)
    tier = F.when(F.col("_held"), F.lit(0)).otherwise(F.lit(1))
    placed = everyone.withColumn("_tier", tier)
    order = [F.col(c) for c in ("_h", "text_crc32", "size", "doc_id", "_spread")]
    # two tiers a shard: the place within the tier, then after the held rows of the shard
    placed = scratch.keep(ranked(placed, ["_label", "_tier"], order, buckets_for(rows // shards), "_place"), "placed")
    tiers = {(r["_label"], r["_tier"]): r["c"] for r in placed.groupBy("_label", "_tier").agg(F.count("*").alias("c")).collect()}  # two rows a shard
    ahead = F.element_at(F.array(*[F.lit(tiers.get((s, 0), 0)) for s in range(shards)]), F.col("_label") + 1)
    limit = F.element_at(F.array(*map(F.lit, quota)), F.col("_label") + 1)
    placed = placed.withColumn("_place", F.col("_place") + F.when(F.col("_tier") == 1, ahead).otherwise(F.lit(0)))
    load = [tiers.get((s, 0), 0) + tiers.get((s, 1), 0) for s in range(shards)]
    # a shard's surplus rows have consecutive places, so surplus rows are numbered over all shards without another sort
    over_before, free_before, over, free = [], [], 0, 0
    for s in range(shards):
        over_before.append(over)
        over += max(0, load[s] - quota[s])
        free_before.append(free)
        free += max(0, quota[s] - load[s])
    number = F.col("_place") - limit + F.element_at(F.array(*map(F.lit, over_before)), F.col("_label") + 1)
    target, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        gap = max(0, quota[s] - load[s])
        inside = (number >= free_before[s]) & (number < free_before[s] + gap)
        target = F.when(inside, F.lit(s)).otherwise(target)
        slot = F.when(inside, number - free_before[s] + load[s]).otherwise(slot)
    keeps = F.col("_place") < limit
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(keeps, F.col("_label")).otherwise(target).cast("int").alias("shard"),
        F.when(keeps, F.col("_place")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
