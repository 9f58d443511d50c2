"""prof_*: profiles of values and schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Column, TableMeta, star_catalog
from ..functions import text
from ..operators import profiling as ops
from .base import register, table

REGISTRY: dict = {}
STAR = star_catalog()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_PROFILED = ("customer", "lineitem", "part")


def _likeness(t: str, c: str) -> str:
    meta = STAR.tables[t]
    base = 0.6 * (c in meta.primary_key) + 0.5 * (c in meta.fk_columns)
    return f"round(least(1.0, {base} + CASE WHEN count(nullif(CAST({c} AS VARCHAR), '')) > 0 AND count(DISTINCT nullif(CAST({c} AS VARCHAR), '')) / greatest(1, count(nullif(CAST({c} AS VARCHAR), ''))) > 0.95 THEN 0.2 ELSE 0.0 END), 6)"


def _profile_sql(t: str, c: str) -> str:
    v = f"nullif(CAST({c} AS VARCHAR), '')"
    return (
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({v}) AS non_null_count, round(1 - count({v}) / count(*), 6) AS null_rate, count(DISTINCT {v}) AS distinct_count, "
        f"round(count(DISTINCT {v}) / greatest(1, count({v})), 6) AS distinct_ratio, min(length({v})) AS min_text_length, max(length({v})) AS max_text_length, round(avg(length({v})), 6) AS mean_text_length, {_likeness(t, c)} AS identifier_likeness FROM {t}"
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register(REGISTRY, "prof_value_profile", " UNION ALL ".join(_profile_sql(t, c) for t in _PROFILED for c in STAR.tables[t].names))
def _(spark, d):
    made = _union([ops.value_profiles(STAR.tables[t], table(spark, d, t)) for t in _PROFILED])
    made = made.withColumns({c: F.col(c).cast("long") for c in ("min_text_length", "max_text_length")})
    return _rounded(made, "null_rate", "distinct_ratio", "mean_text_length", "identifier_likeness")


def _flags_sql(t: str, c: str, order: str) -> str:
    flags = ops.name_flags(STAR.tables[t], c)
    like = any(flags[f"{k}_like"] for k in ("title", "abstract", "review", "isbn", "email", "url"))
    names = ", ".join(f"{str(v).upper()} AS {k}" for k, v in flags.items())
    return (
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {names}, bool_or(r <= 20 AND contains(v, '@')) AS contains_at_sign, bool_or(r <= 20 AND regexp_matches(lower(v), '^https?://')) AS contains_url_prefix, "
        f"bool_or(regexp_matches(lower(v), '{ops.ISBN}')) AS contains_isbn_shape, {str(like).upper()} AS text_like FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {order}) AS r FROM {t}) WHERE r <= 50"
    )


@register(REGISTRY, "prof_column_flags", " UNION ALL ".join(_flags_sql(t, c, o) for t, o in (("pages", "page_id"), ("part", "p_partkey")) for c in STAR.tables[t].names if c != "html"))
def _(spark, d):
    return _union([ops.column_flags(STAR.tables[t], table(spark, d, t), o) for t, o in (("pages", "page_id"), ("part", "p_partkey"))]).filter("column_name <> 'html'")


def _summary_sql(t: str, c: str) -> str:
    v = f"nullif(CAST({c} AS VARCHAR), '')"
    ident = f"(regexp_matches(trim({v}), '^[A-Za-z0-9_-]{{1,12}}$') OR regexp_matches(trim({v}), '^[A-Za-z]?[0-9]+[A-Za-z]?$'))"
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({v}) AS non_empty_count, count(*) - count({v}) AS null_empty_count, round((count(*) - count({v})) / count(*), 6) AS null_empty_rate, count(DISTINCT {v}) AS distinct_count, round(count(*) FILTER ({ident}) / count({v}), 6) AS identifier_like_rate FROM {t}"


_SUMMED = (("part", ["p_partkey", "p_name", "p_brand", "p_type"]), ("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


@register(REGISTRY, "prof_row_summary", " UNION ALL ".join(_summary_sql(t, c) for t, cs in _SUMMED for c in cs))
def _(spark, d):
    return _rounded(_union([ops.row_summary(STAR.tables[t], table(spark, d, t), cs) for t, cs in _SUMMED]), "null_empty_rate", "identifier_like_rate")


@register(REGISTRY, "prof_identifier_like", "SELECT p_name, (regexp_matches(trim(p_name), '^[A-Za-z0-9_-]{1,12}$') OR regexp_matches(trim(p_name), '^[A-Za-z]?[0-9]+[A-Za-z]?$')) AS identifier_like, count(*) AS n FROM part GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_name", text.identifier_like(F.col("p_name")).alias("identifier_like")).agg(F.count("*").alias("n"))


@register(REGISTRY, "prof_samples", "SELECT p_type, string_agg(p_name, ',' ORDER BY p_name) AS samples FROM (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS r FROM (SELECT DISTINCT p_type, p_name FROM part WHERE p_name <> '')) WHERE r <= 5 GROUP BY p_type")
def _(spark, d):
    return ops.value_samples(table(spark, d, "part"), ["p_type"], "p_name")


@register(REGISTRY, "prof_uri_key", "SELECT 'part' AS table_name, 'p_partkey' AS id_columns, 'primary_key' AS reason, 3.0::DOUBLE AS score UNION ALL SELECT 'region', 'r_regionkey', 'unique_non_null_profile', 2.2::DOUBLE FROM (SELECT count(*) AS n, count(DISTINCT r_regionkey) AS k FROM region) WHERE n = k UNION ALL SELECT 'lines', 'l_returnflag', 'fallback_table_key', 0.5::DOUBLE")
def _(spark, d):
    bare = TableMeta("region", STAR.tables["region"].columns)
    lines = TableMeta("lines", (Column("l_returnflag"), Column("l_linestatus")))
    some = ((STAR.tables["part"], "part"), (bare, "region"), (lines, "lineitem"))
    return _union([ops.uri_keys(m, ops.value_profiles(m, table(spark, d, t))) for m, t in some])


@register(REGISTRY, "prof_discriminators", "SELECT 'labels' AS table_name, c AS column_name, count(DISTINCT v) AS distinct_values, count(*) FILTER (v IN ('1','t','true','yes','y')) AS truthy_rows FROM (SELECT 'toxic' c, CAST(toxic AS VARCHAR) v FROM labels UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM labels) GROUP BY c HAVING count(*) FILTER (v IN ('1','t','true','yes','y')) > 0")
def _(spark, d):
    cells = table(spark, d, "labels").select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in ("toxic", "quality")])).alias("x")).select("x.*")
    return cells.groupBy(F.lit("labels").alias("table_name"), "column_name").agg(F.count_distinct("v").alias("distinct_values"), F.count_if(text.truthy(F.col("v"))).alias("truthy_rows")).filter("truthy_rows > 0")


_GOES = "CASE column_name WHEN 'p_name' THEN 'http://x#name' WHEN 'p_size' THEN 'http://x#description' WHEN 'p_partkey' THEN 'http://x#partCode' WHEN 'p_brand' THEN 'http://x#title' ELSE 'http://x#other' END"


@register(
    REGISTRY,
    "prof_compat",
    f"SELECT column_name, (identifier_likeness < 0.7 OR target = 'http://x#partCode') AND (NOT target IN ('http://x#name', 'http://x#description', 'http://x#title') OR mean_text_length >= 3) AS fits FROM (SELECT *, {_GOES} AS target FROM ({' UNION ALL '.join(_profile_sql('part', c) for c in STAR.tables['part'].names)}))",
)
def _(spark, d):
    from ..operators.validation import identifier_target

    p = ops.value_profiles(STAR.tables["part"], table(spark, d, "part")).withColumn("target", F.expr(_GOES))
    words = text.word_set(text.local_name(F.col("target")))
    return ops.fits_target(p, identifier_target(text.local_name(F.col("target"))), F.arrays_overlap(words, F.array(*map(F.lit, ("name", "description", "title"))))).select("column_name", "fits")
