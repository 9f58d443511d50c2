"""Embedded records on disk: an index of metadata and vectors, and a cache that only grows by what it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import vector_issue
from .files import read_jsonl

#: What tells an embedding's origin; rows of a cache count only where all of it is the same.
PROVENANCE = ("provider", "model", "verbalization")
CACHE = "hash string, provider string, model string, verbalization string, dimension int, embedding array<double>"


def checked(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows, if all vectors are finite and of one length; else an error that says how many of which kind are not."""
    size = rows.agg(F.max(F.size(vector))).first()[0]
    if size is None:
        raise ValueError("no embedded records to index")
    bad = rows.select(vector_issue(F.col(vector), size).alias("issue")).filter("issue IS NOT NULL").groupBy("issue").count().collect()  # a row a kind of issue
    if bad:
        raise ValueError(", ".join(f"{r['count']} vectors: {r['issue']}" for r in bad))
    return rows


def write_index(rows: DataFrame, path: str, key: str, vector: str = "embedding") -> None:
    """``path``/meta: the records without vectors as JSON lines; ``path``/vectors: key and array<double> as Parquet, sorted by key within files."""
    held = checked(rows, vector)
    held.drop(vector).write.mode("overwrite").json(f"{path}/meta")
    held.select(key, F.col(vector).cast("array<double>").alias(vector)).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/vectors")


def cache_key(text, **provenance: str):
    """SHA-256 of the provenance and the text, as sorted JSON."""
    fields = {**{k: F.lit(v) for k, v in provenance.items()}, "text": text}
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())])), 256)


def read_cache(spark: SparkSession, path: str, **provenance: str) -> DataFrame:
    """(hash, embedding) of the cache's rows whose provenance is all as given. A row of it whose vector has not the length it states is an error."""
    rows = read_jsonl(spark, path, CACHE)
    for name in PROVENANCE:
        rows = rows.filter(F.col(name) == provenance[name])
    wrong = F.col("dimension").isNull() | (F.size("embedding") != F.col("dimension"))
    lost = F.raise_error(F.concat(F.lit("a cached embedding without its stated length: "), "hash")).cast("array<double>")
    return rows.select("hash", F.when(wrong, lost).otherwise(F.col("embedding")).alias("embedding"))


def append_cache(rows: DataFrame, path: str, **provenance: str) -> DataFrame:
    """Writes those of (hash, embedding) that the cache lacks and returns them; a hash that comes twice is written once."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(["hash"]).join(read_cache(spark, path, **provenance).select("hash"), "hash", "left_anti")
    made = new.select("hash", *[F.lit(provenance[n]).alias(n) for n in PROVENANCE], F.size("embedding").alias("dimension"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = checked(made) if not made.isEmpty() else made
    made.select(*sorted(made.columns)).write.mode("append").json(path)
    return new
