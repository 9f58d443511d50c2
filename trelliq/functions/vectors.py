"""Vector functions in double precision, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import spread
from .text import each


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: str = "zero") -> Column:
    """Cosine; a zero vector or different lengths give 0, or an error where ``zero`` is ``"error"``."""
    n = norm(a) * norm(b)
    bad = (n == 0) | (F.size(a) != F.size(b))
    return F.when(bad, F.raise_error(F.lit("a zero vector has no cosine")).cast("double") if zero == "error" else F.lit(0.0)).otherwise(dot(a, b) / n)


def vector_issue(v: Column, size: int) -> Column:
    """Why a vector can't be used; null if it can."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) == 0), "empty").when(odd, "not_finite").when(F.size(v) != size, "dimension_mismatch")


def hash_embedding(rows: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """(key, idx, w): non-zero coordinates of the signed hashing of white-space tokens, each text's of length one."""
    words = spread(rows).select(key, F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "").alias("_t"))
    toks = each(words, "_t", "t")
    h = toks.select(key, F.sha2("t", 256).alias("h"))
    at = h.select(key, (F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("long") % size).cast("int").alias("idx"), F.when(F.conv(F.substr("h", F.lit(9), F.lit(2)), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1).alias("sign"))
    sums = at.groupBy(key, "idx").agg(F.sum("sign").cast("double").alias("s")).filter("s <> 0")
    total = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    return sums.join(total, key).select(key, "idx", (F.col("s") / F.col("n")).alias("w"))
