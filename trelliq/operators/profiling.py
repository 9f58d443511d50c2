"""Profiles of values, columns and schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, TableMeta
from ..functions import text

# Words of names that tell what values are, short identifier names, and the shape of an ISBN.
NAME_WORDS = {
    "title": {"title", "name", "label"},
    "abstract": {"abstract", "summary"},
    "review": {"review", "comment", "text", "description"},
    "isbn": {"isbn"},
    "date": {"date", "time", "year"},
    "email": {"email", "mail"},
    "url": {"url", "uri", "link", "homepage", "web"},
}
ID_NAMES = {"pid", "rid", "aid", "oid", "cid", "uid"}
ISBN = r"\b(?:97[89][-\s]?)?\d[-\s]?\d{2,5}[-\s]?\d{2,7}[-\s]?[0-9x]\b"


def identifier_likeness(meta: TableMeta, column: str, near_unique: Column) -> Column:
    low = column.lower()
    score = 0.6 * (column in meta.primary_key) + 0.5 * (column in meta.fk_columns)
    score += 0.4 * (low == "id" or low.endswith("_id") or low in ID_NAMES)
    return F.least(F.lit(1.0), F.lit(float(score)) + F.when(near_unique, 0.2).otherwise(0.0))


def value_profiles(meta: TableMeta, df: DataFrame) -> DataFrame:
    """A row a column: counts, lengths, distinctness and identifier likeness; null and empty values are none.

    One scan: cells become (column, value) pairs that are counted before they move, so a column with few values costs a
    few rows, and no column's distinct values are shuffled for each other column.
    """
    names = [c for c in meta.names if c in df.columns]
    n = F.when(F.col("v").isNotNull(), F.col("n"))
    per = _cells(df, names).groupBy("i", "v").agg(F.count("*").alias("n")).groupBy("i").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(n), F.lit(0)).alias("non_null_count"), F.count("v").alias("distinct_count"), F.min(F.length("v")).alias("lo"), F.max(F.length("v")).alias("hi"), (F.sum(n * F.length("v")) / F.sum(n)).alias("mean"),
    )
    every = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "i int, column_name string")  # a row a column
    out = every.join(per, "i", "left")
    rows, good, dist = (F.coalesce(c, F.lit(0)) for c in ("row_count", "non_null_count", "distinct_count"))
    ratio = dist / F.greatest(good, F.lit(1))
    likeness = F.lit(0.0)
    for i, c in enumerate(names):
        likeness = F.when(F.col("i") == i, identifier_likeness(meta, c, (good > 0) & (ratio > 0.95))).otherwise(likeness)
    return out.select(
        F.lit(meta.name).alias("table_name"), "column_name", rows.alias("row_count"), good.alias("non_null_count"), F.when(rows > 0, 1 - good / rows).otherwise(1.0).alias("null_rate"), dist.alias("distinct_count"), ratio.alias("distinct_ratio"),
        F.coalesce("lo", F.lit(0)).alias("min_text_length"), F.coalesce("hi", F.lit(0)).alias("max_text_length"), F.coalesce("mean", F.lit(0.0)).alias("mean_text_length"), likeness.alias("identifier_likeness"),
    )


def fits_target(profiles: DataFrame, identifier_words: Column, text_words: Column) -> DataFrame:
    """The profiles with ``fits``: an identifier (likeness from 0.7 on) needs a target that names one, a text target needs values of three characters on average."""
    identifier = F.col("identifier_likeness") >= 0.7
    return profiles.withColumn("fits", (~identifier | identifier_words) & (~text_words | (F.col("mean_text_length") >= 3)))


def name_flags(meta: TableMeta, column: str) -> dict[str, bool]:
    from ..plans.compiler import word_set

    have = word_set(f"{meta.name} {column}")
    return {f"{k}_like": bool(have & w) for k, w in NAME_WORDS.items()}


def column_flags(meta: TableMeta, df: DataFrame, order: str) -> DataFrame:
    """Name flags and, of the first 20 values in the given order (50 for the ISBN shape), content flags; a row a column."""
    head = df.filter(F.col(order).isNotNull()).orderBy(order).limit(50).select(*[F.col(c).cast("string").alias(c) for c in meta.names if c in df.columns], F.row_number().over(_by(order)).alias("_r"))
    aggs = []
    names = [c for c in meta.names if c in df.columns]
    for c in names:
        v = F.when(F.col(c) != "", F.col(c))
        early = F.when(F.col("_r") <= 20, v)
        aggs += [F.coalesce(F.bool_or(F.contains(early, F.lit("@"))), F.lit(False)).alias(f"{c}|at"), F.coalesce(F.bool_or(F.lower(early).rlike("^https?://")), F.lit(False)).alias(f"{c}|url"), F.coalesce(F.bool_or(F.lower(v).rlike(ISBN)), F.lit(False)).alias(f"{c}|isbn")]
    one = head.agg(*aggs)
    cols = []
    for c in names:
        flags = name_flags(meta, c)
        like = any(flags[f"{k}_like"] for k in ("title", "abstract", "review", "isbn", "email", "url"))
        cols.append(F.struct(F.lit(meta.name).alias("table_name"), F.lit(c).alias("column_name"), *[F.lit(v).alias(k) for k, v in flags.items()], F.col(f"`{c}|at`").alias("contains_at_sign"), F.col(f"`{c}|url`").alias("contains_url_prefix"), F.col(f"`{c}|isbn`").alias("contains_isbn_shape"), F.lit(like).alias("text_like")))
    return one.select(F.explode(F.array(*cols)).alias("p")).select("p.*")


def _by(order: str):
    return Window.orderBy(order)  # over 50 rows at most


def row_summary(meta: TableMeta, df: DataFrame, columns: list[str]) -> DataFrame:
    """Null-or-empty rate, distinct values, share of identifier-like values; a row a column, one scan: values are counted before they move."""
    every = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, column_name string")  # a row a column
    n = F.when(F.col("v").isNotNull(), F.col("n"))
    per = _cells(df, columns).groupBy("i", "v").agg(F.count("*").alias("n")).groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(n).alias("good"), F.count("v").alias("distinct"), F.sum(F.when(text.identifier_like(F.col("v")), n)).alias("like"),
    )
    rows, good, distinct, like = (F.coalesce(c, F.lit(0)) for c in ("rows", "good", "distinct", "like"))
    return every.join(per, "i", "left").select(
        F.lit(meta.name).alias("table_name"), "column_name", rows.alias("row_count"), good.alias("non_empty_count"), (rows - good).alias("null_empty_count"),
        F.coalesce(F.try_divide(rows - good, rows), F.lit(0.0)).alias("null_empty_rate"), distinct.alias("distinct_count"), F.coalesce(F.try_divide(like, good), F.lit(0.0)).alias("identifier_like_rate"),
    )


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v): each cell's column by its number and its text, null if empty."""
    return df.select(F.explode_outer(F.array(*[F.struct(F.lit(i).alias("i"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def value_samples(df: DataFrame, key: list[str], column: str, most: int = 5) -> DataFrame:
    """Each key's first values in order (at most ``most``): ranked before they are gathered, so no group is held whole."""
    v = df.select(*key, F.col(column).cast("string").alias("value")).filter("value <> ''").distinct()
    first = v.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("value"))).filter(F.col("_r") <= most)
    return first.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("samples"))


def components(catalog: Catalog) -> list[tuple[int, str]]:
    """(component, table) of the undirected key graph, components numbered by their first table's name."""
    root = {n: n for n in catalog.tables}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for t in catalog.tables.values():
        for fk in t.foreign_keys:
            if fk.ref_table in root:
                a, b = sorted((find(t.name), find(fk.ref_table)))
                root[b] = a
    number = {r: i for i, r in enumerate(sorted({find(n) for n in root}))}
    return sorted((number[find(n)], n) for n in root)


def uri_keys(meta: TableMeta, profiles: DataFrame) -> DataFrame:
    """The columns that name a row: the primary key (3), else unique columns without nulls (2 and their likeness), else the table key."""
    options = [F.struct(F.lit(3.0).alias("score"), F.lit(0).alias("o"), F.lit(",".join(meta.primary_key)).alias("id_columns"), F.lit("primary_key").alias("reason"))] if meta.primary_key else []
    unique = profiles.filter((F.col("null_rate") == 0) & (F.col("distinct_ratio") >= 0.98)).agg(F.max(F.struct((F.lit(2.0) + F.col("identifier_likeness")).alias("score"), (-F.array_position(F.array(*map(F.lit, meta.names)), F.col("column_name"))).cast("int").alias("o"), F.col("column_name").alias("id_columns"), F.lit("unique_non_null_profile").alias("reason"))).alias("u"))
    spare = F.struct(F.lit(0.5).alias("score"), F.lit(0).alias("o"), F.lit(",".join(meta.key)).alias("id_columns"), F.lit("fallback_table_key").alias("reason"))
    best = reduce(lambda a, b: F.greatest(a, b), [F.coalesce(F.col("u"), spare), *options], spare)
    return unique.select(F.lit(meta.name).alias("table_name"), best.alias("b")).select("table_name", "b.id_columns", "b.reason", "b.score")
