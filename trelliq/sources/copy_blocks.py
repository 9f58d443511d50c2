"""COPY blocks of SQL dumps as a Spark data source: ``spark.read.format("copy_block")``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import Catalog
from .ddl import bare

_HEAD = re.compile(r'^COPY\s+(?P<name>(?:"[^"]+"|[\w$.-]+)+)\s*\((?P<columns>.*)\)\s+FROM\s+stdin;\s*$', re.I)


def copy_rows(lines: Iterator[str]) -> Iterator[tuple[str, list[str], list[str | None]]]:
    r"""(table, columns, values) of each row: cells between tabs, \N is null, \. ends a block, short rows lack their last cells."""
    table, columns = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if table is None:
            if m := _HEAD.match(line):
                table = bare(m["name"])
                columns = [bare(c) for c in re.findall(r'"[^"]+"|[^,\s]+', m["columns"])]
            continue
        if line == r"\.":
            table = None
            continue
        cells = [None if c == r"\N" else c for c in line.split("\t")][: len(columns)]
        yield table, columns[: len(cells)], cells


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value.removeprefix("file://")
        with open(path, encoding="utf-8") as f:
            for table, columns, cells in copy_rows(f):
                yield table, dict(zip(columns, cells, strict=True))


class CopyBlockSource(DataSource):
    """Rows (table_name, cells map<string,string>); a partition a dump, as a block's columns stand at its head only."""

    @classmethod
    def name(cls) -> str:
        return "copy_block"

    def schema(self) -> str:
        return "table_name string, cells map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    """The source for paths that Python can open."""
    spark.dataSource.register(CopyBlockSource)
    return spark.read.format("copy_block").option("path", path).load()


def read_copy_anywhere(spark: SparkSession, path: str) -> DataFrame:
    """The same rows for any path that Spark reads: whole dumps as rows, parsed where they are read."""
    def parse(batches):
        import pandas as pd

        for b in batches:
            made = [(t, list(zip(c, v, strict=True))) for text in b["value"] for t, c, v in copy_rows(iter(text.split("\n")))]
            yield pd.DataFrame({"table_name": [t for t, _ in made], "pairs": [[{"k": k, "v": v} for k, v in p] for _, p in made]})

    rows = spark.read.text(path, wholetext=True).mapInPandas(parse, "table_name string, pairs array<struct<k:string,v:string>>")
    return rows.select("table_name", F.map_from_entries("pairs").alias("cells"))


def frames(rows: DataFrame, catalog: Catalog) -> dict[str, DataFrame]:
    """A frame for each table; rows without one of its columns are not its own (tables of one name in two schemas)."""
    out = {}
    for name, meta in catalog.tables.items():
        has = F.size(F.array_except(F.array(*map(F.lit, meta.names)), F.map_keys("cells"))) == 0
        out[name] = rows.filter((F.col("table_name") == name) & has).select(*[F.element_at("cells", F.lit(c)).alias(c) for c in meta.names])
    return out
