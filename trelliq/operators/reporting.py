"""Ledgers, summaries and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Fixed values in what follows: the names of failure modes, and the sentences that name a likely cause.


def failure_mode(sql_rows: Column, graph_rows: Column, precision: Column, recall: Column, categories: Column) -> Column:
    """What went wrong with a query pair, first test that holds; null where nothing did or both sides are empty."""
    low = F.lower(categories)
    linked = F.contains(low, F.lit("object")) | F.array_contains(F.split(low, r"[,;\s]+"), "ref")
    return (
        F.when(((sql_rows == 0) & (graph_rows == 0)) | ((precision == 1) & (recall == 1)), None).when((graph_rows == 0) & (sql_rows > 0), "zero_sparql_answers").when((sql_rows == 0) & (graph_rows > 0), "overgenerated_sparql_answers")
        .when((recall < 1) & linked, "missing_or_wrong_link_path").when(recall < 1, "missing_attribute_or_class").when((precision < 1) & (graph_rows > sql_rows), "overgenerated_sparql_answers").otherwise("other")
    )


def likely_cause(sql_rows: Column, graph_rows: Column) -> Column:
    """A failed pair's likely cause from its numbers of rows."""
    return (
        F.when((sql_rows > 0) & (graph_rows == 0), "missing RDF class/property/path").when((graph_rows > 0) & (sql_rows == 0), "false-positive RDF output")
        .when(sql_rows == graph_rows, "value or literal-normalization mismatch").otherwise("partial coverage or extra rows")
    )


def append_ledger(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """The ledger with a run's rows, whichever columns either has; iterations go on from the scenario's last."""
    last = ledger.groupBy("scenario").agg(F.max("iteration").alias("_last"))
    w = Window.partitionBy("scenario").orderBy("started")
    new = run.join(last, "scenario", "left").withColumn("iteration", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_last")
    return ledger.unionByName(new, allowMissingColumns=True)


def summary(ledger: DataFrame) -> DataFrame:
    """Per scenario: first and last score, runs, seconds, status of the last run and the most common cause of failure."""
    causes = ledger.filter("cause is not null").groupBy("scenario", "cause").agg(F.count("*").alias("n")).groupBy("scenario").agg(F.max_by("cause", F.struct("n", "cause")).alias("top_cause"))
    out = ledger.groupBy("scenario").agg(
        F.count("*").alias("runs"), F.min_by("f1", "iteration").alias("first_f1"), F.max_by("f1", "iteration").alias("last_f1"), F.sum("seconds").alias("seconds"), F.max_by("status", "iteration").alias("status"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "note"))), lambda x: x["note"]), "; ").alias("notes"),
    )
    return out.join(causes, "scenario", "left").withColumn("gain", F.col("last_f1") - F.col("first_f1"))


def event_stats(lines: DataFrame, column: str = "line") -> DataFrame:
    """Counters that progress lines of the form ``matched n/m ... seconds=x`` reach at most."""
    part = lambda p, k: F.regexp_extract(column, p, k)
    return lines.agg(F.max(F.nullif(part(r"matched (\d+)/(\d+)", 1), F.lit("")).cast("long")).alias("matched"), F.max(F.nullif(part(r"matched (\d+)/(\d+)", 2), F.lit("")).cast("long")).alias("total"), F.max(F.nullif(part(r"seconds=([0-9.]+)", 1), F.lit("")).cast("double")).alias("seconds"))


def cost(rows: Column, records: Column, per_row: float = 0.001, per_program: float = 0.005, per_record: float = 0.000002) -> Column:
    return rows * per_row + per_program + records * per_record


def compare(scenarios: DataFrame, ours: DataFrame, baseline: DataFrame, margin: float = 0.01) -> DataFrame:
    """Scores beside the baseline's, the difference, and whether to promote: better, or as good within the margin with fewer invalid rules."""
    out = scenarios.join(ours, "scenario", "left").join(baseline.select("scenario", F.col("f1").alias("baseline_f1"), F.col("invalid").alias("baseline_invalid")), "scenario", "left")
    delta = F.col("f1") - F.col("baseline_f1")
    decision = F.when(F.col("f1").isNull() | F.col("baseline_f1").isNull(), "pending").when(delta > margin, "promote").when((delta >= -margin) & (F.col("invalid") < F.col("baseline_invalid")), "promote").when(delta >= -margin, "keep").otherwise("reject")
    return out.select("scenario", "f1", "baseline_f1", delta.alias("delta"), decision.alias("decision"))


def arm_comparison(arms: DataFrame, selected: DataFrame) -> DataFrame:
    """Every arm's row, failed ones as well, and one named portfolio_selected for the arm that was chosen."""
    pick = arms.join(selected, ["scenario", "arm"], "left_semi").withColumn("arm", F.lit("portfolio_selected"))
    return arms.unionByName(pick)


def pivot(rows: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, names).agg(F.max(value))
