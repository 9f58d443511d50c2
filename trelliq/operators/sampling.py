"""Stable samples of related tables: a hash of the key decides, then foreign keys are closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, ForeignKey
from ..functions import text
from ..lineage import cut


def kept_by_hash(catalog: Catalog, name: str, df: DataFrame, fraction: float, seed: str) -> Column:
    return text.stable_keep(seed, name, [F.col(c) for c in catalog.tables[name].sampling_key], fraction)


def _on(child: str, parent: str, fk: ForeignKey) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{child}.{c}") == F.col(f"{parent}.{r}") for c, r in zip(fk.columns, fk.ref_columns, strict=True)])


def closed_sample(catalog: Catalog, frames: dict[str, DataFrame], fraction: float, seed: str) -> dict[str, DataFrame]:
    """A sample in which every kept row's referenced rows are kept.

    Tables made of foreign keys alone are sampled last, from rows whose every referenced row is kept. The whole
    fraction copies everything. The key graph is walked children first, so one pass closes acyclic schemas; tables on
    a cycle are gone through again until nothing is added.
    """
    if fraction == 1.0:
        return dict(frames)
    plain = [n for n in frames if n in catalog.tables and not catalog.tables[n].join_like]
    kept = {n: frames[n].filter(kept_by_hash(catalog, n, frames[n], fraction, seed)) for n in plain}
    order, cyclic = _children_first(catalog, plain)

    def pull(names: list[str]) -> None:
        for parent in names:
            needed = []
            for child in plain:
                for fk in catalog.tables[child].foreign_keys:
                    if fk.ref_table == parent:
                        needed.append(kept[child].select(*[F.col(c).alias(r) for c, r in zip(fk.columns, fk.ref_columns, strict=True)]).dropna().distinct())
            for keys in needed:
                more = frames[parent].join(keys, keys.columns, "left_semi").select(*frames[parent].columns)
                key = list(catalog.tables[parent].sampling_key)
                kept[parent] = kept[parent].unionByName(more).dropDuplicates(key)

    pull(order)
    before = None
    while cyclic:
        counts = [kept[n].count() for n in cyclic]
        if counts == before:
            break
        before = counts
        pull(cyclic)
        for n in cyclic:
            kept[n] = cut(kept[n])
        pull([n for n in order if n not in cyclic])
    for n in frames:
        meta = catalog.tables.get(n)
        if meta is None or not meta.join_like:
            continue
        rows = frames[n].filter(kept_by_hash(catalog, n, frames[n], fraction, seed))
        for fk in meta.foreign_keys:
            if fk.ref_table in kept:
                rows = rows.alias("c").join(kept[fk.ref_table].alias("p"), _on("c", "p", fk), "left_semi")
        kept[n] = rows
    return {n: kept[n] for n in frames if n in kept}


def _children_first(catalog: Catalog, names: list[str]) -> tuple[list[str], list[str]]:
    """Tables so that each comes after all that refer to it; those on or above a cycle apart."""
    left = {n: {c for c in names for fk in catalog.tables[c].foreign_keys if fk.ref_table == n and c != n} for n in names}
    loops = {n for n in names if any(fk.ref_table == n for fk in catalog.tables[n].foreign_keys)}
    order: list[str] = []
    while free := [n for n in left if not left[n] - set(order) and n not in order]:
        order += free
    cyclic = [n for n in names if n not in order] + sorted(loops)
    return order + [n for n in names if n not in order], cyclic


def sample_summary(frames: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    """Rows before and after, a row a table."""
    parts = [frames[n].agg(F.count("*").alias("full_rows")).select(F.lit(n).alias("table_name"), "full_rows") for n in kept]
    after = [kept[n].agg(F.count("*").alias("dev_rows")).select(F.lit(n).alias("table_name"), "dev_rows") for n in kept]
    return reduce(DataFrame.unionByName, parts).join(reduce(DataFrame.unionByName, after), "table_name")
