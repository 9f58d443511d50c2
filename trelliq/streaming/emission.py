"""Facts from a stream of rows: emission needs nothing but the row and static key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..plans.materialize import RulePlanner
from ..plans.rules import Rule


def stream_triples(scenario: str, catalog: Catalog, stream: DataFrame, table: str, static: dict[str, DataFrame], rules: list[Rule], event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Facts of the rules over one streamed table; referenced tables are static, so existence is a stream-static semi join.

    With ``event_time`` facts are a set within the watermark; without, repetitions stay for the sink to drop.
    """
    own = [r for r in rules if r.source_table == table]
    if event_time is None:
        return RulePlanner(scenario, catalog, static | {table: stream}, own).triples()
    timed = stream.withWatermark(event_time, delay)
    planned = RulePlanner(scenario, catalog, static | {table: timed}, own)
    local = [r for r in own if not planned._sides(r)]
    row = planned._row(table)
    made = []
    for r in local:
        s, o, literal = planned._triple(r, row)
        made.append(F.when(planned._filter(r, row) if r.kind == "class" else row[r.source_column] != "", F.struct(s.alias("s"), F.lit(planned._predicate(r)).alias("p"), o.alias("o"), literal.alias("is_literal"))))
    facts = timed.select(F.col(event_time), F.explode(F.filter(F.array(*made), lambda t: t.isNotNull())).alias("t")).select(event_time, "t.*")
    return facts.dropDuplicatesWithinWatermark(["s", "p", "o", "is_literal"])
