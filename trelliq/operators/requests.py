"""What goes into requests to a decision provider, and what comes back: chunks, budgets, siblings, token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Groups whose places in chunks one task fills in, about.
TASK_GROUPS = 50_000


def chunked(rows: DataFrame, group: str, order: str, size: int, within: str | None = None) -> DataFrame:
    """rows with ``chunk``, a number within ``within`` (or over all): whole groups in order share a chunk while they fit.

    A group of more than ``size`` rows is cut into chunks of its own. The groups before it that still shared one stay
    together. Greedy filling goes from group to group in order, so the groups' counts (a row a group) of a value of
    ``within`` pass through one task, some TASK_GROUPS of them at once; the rows themselves don't.
    """
    scope = [within] if within else []
    counts = rows.groupBy(*scope, group).agg(F.count("*").alias("n"))

    def fill(groups):
        import pandas as pd

        groups = groups.sort_values([*scope, group], kind="stable")
        first, held, number, before = [], 0, 0, None
        for here, n in zip(groups[within] if within else [0] * len(groups), groups["n"], strict=True):
            if here != before:
                held, number, before = 0, 0, here
            if n > size:
                number += held > 0
                first.append(number)
                number, held = number + -(-n // size), 0
                continue
            if held and held + n > size:
                number, held = number + 1, 0
            first.append(number)
            held += n
        return pd.DataFrame({**{c: groups[c] for c in scope}, group: groups[group], "first": first})

    names = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in [*scope, group])
    tasks = counts.count() // TASK_GROUPS + 1 if scope else 1
    starts = counts.groupBy(F.pmod(F.xxhash64(*scope), F.lit(tasks)) if scope else F.lit(0)).applyInPandas(fill, f"{names}, first long")
    w = Window.partitionBy(*scope, group).orderBy(order)
    placed = rows.withColumn("_i", F.row_number().over(w) - 1).join(starts, list(dict.fromkeys([*scope, group])))
    return placed.withColumn("chunk", (F.col("first") + F.floor(F.col("_i") / size)).cast("long")).drop("_i", "first")


def halved(rows: DataFrame, chunk: str, order: str, length: str, budget: int) -> DataFrame:
    """rows with ``part``: chunks whose lengths sum up to more than ``budget`` are halved until every part fits.

    Halving is by number of rows, the first half the smaller one. A single row above the budget raises an error.
    """
    parts = rows.withColumn("part", F.lit(""))
    while True:
        w = Window.partitionBy(chunk, "part")
        sized = parts.withColumn("_s", F.sum(length).over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)))
        over = F.col("_s") > budget
        alone = F.when(over & (F.col("_n") == 1), F.raise_error(F.concat(F.lit("a single row exceeds the budget: "), F.col(order).cast("string"))).cast("string"))
        half = F.when(F.col("_i") <= F.floor(F.col("_n") / 2), F.concat("part", F.lit("0"))).otherwise(F.concat("part", F.lit("1")))
        new = sized.withColumn("part", F.when(over & (F.col("_n") > 1), half).otherwise(F.coalesce(alone, F.col("part"))))
        if sized.filter(over & (F.col("_n") > 1)).isEmpty():
            return new.drop("_s", "_n", "_i")
        from ..lineage import cut

        parts = cut(new.drop("_s", "_n", "_i"))


def siblings(decisions: DataFrame, group: str, order: str, most: int = 40) -> DataFrame:
    """(group, siblings): each group's first ``most`` accepted decisions, ranked before they are gathered."""
    w = Window.partitionBy(group).orderBy(order)
    few = decisions.filter("target IS NOT NULL").withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= most)
    return few.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "target"))), lambda x: x["target"]).alias("siblings"))


def usage_totals(answers: DataFrame, usage: str) -> DataFrame:
    """(counter, total) over maps of counters; values that are no whole numbers are left out."""
    return answers.select(F.explode(usage).alias("counter", "value")).groupBy("counter").agg(F.sum(F.col("value").try_cast("long")).alias("total")).filter("total IS NOT NULL")
