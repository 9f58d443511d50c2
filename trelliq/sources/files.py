"""Plain files in and out: JSON lines, CSV with fixed fields, N-Triples, COPY dumps, tables as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..catalog import Catalog
from ..plans.materialize import n_triples


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema; a path without files is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named fields in their order; a missing field or value is empty."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields]
    df.select(*kept).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_n_triples(triples: DataFrame, path: str) -> None:
    """One fact a line. Spark's committer leaves no partial output behind a failed job."""
    n_triples(triples).write.mode("overwrite").text(path)


def write_copy(df: DataFrame, catalog: Catalog, table: str, path: str) -> None:
    r"""A table's rows as the body of a COPY block: tabs between cells, \N for null."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(r"\N")) for c in catalog.tables[table].names]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def register_scenario(spark: SparkSession, frames: dict[str, DataFrame], prefix: str = "") -> None:
    """Tables as temporary views, so that a scenario's SQL texts run as they are."""
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)


def as_text(rows: DataFrame) -> DataFrame:
    """Rows with every cell as text."""
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """A SQL text's rows with every cell as text."""
    return as_text(spark.sql(sql))


def write_dump(definitions: str, frames: dict[str, DataFrame], catalog: Catalog, path: str) -> None:
    """A dump: the text of the definitions with its COPY blocks' bodies replaced by the rows of ``frames``.

    Statements keep their places. A table's rows are written by as many tasks as hold them; part files in order of their
    names are the dump. Tables without a frame keep an empty block.
    """
    spark = next(iter(frames.values())).sparkSession
    lines, body, place, blocks = [], False, 0, {}
    for line in definitions.splitlines():
        if body:
            body = line != r"\."
            if body:
                continue
        lines.append((place, line))
        place += 1
        if match := re.match(r"COPY\s+(?:\w+\.)?\"?([\w-]+)\"?", line, re.I):
            body, blocks[match[1]] = True, place
            place += 1  # its rows stand here
    out = spark.createDataFrame(lines, "place int, value string")
    for name, at in blocks.items():
        if name in frames:
            cells = [F.coalesce(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit(r"\N")) for c in catalog.tables[name].names]
            out = out.unionByName(frames[name].select(F.lit(at).alias("place"), F.concat_ws("\t", *cells).alias("value")))
    out.orderBy("place").select("value").write.mode("overwrite").text(path)


def append_csv_ledger(run: DataFrame, path: str, fields: list[str]) -> DataFrame:
    """The ledger at ``path`` with a run's rows, under the header ``fields``, whatever header it had; written beside and moved into place."""
    spark = run.sparkSession
    jvm = spark.sparkContext._jvm
    here, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, path.rstrip("/") + ".new"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aligned = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields])
    every = aligned(read_csv(spark, path)).unionByName(aligned(run)) if fs.exists(here) else aligned(run)
    write_csv(every, str(new), fields)
    fs.delete(here, True)
    fs.rename(new, here)
    return read_csv(spark, path)
