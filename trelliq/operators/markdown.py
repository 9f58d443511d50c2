"""Reports as Markdown: lines are made by Spark; only what a report lists, a bounded number of rows, comes to the driver."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table in a report at most; what is left out is said under the table.
LISTED = 1000


def rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A table row for each row of ``df``; nulls are empty, a bar in a value is escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in fields]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def table(df: DataFrame, fields: Sequence[str], order: Sequence[str], titles: Sequence[str] | None = None, numbers: Sequence[str] = ()) -> list[str]:
    """The lines of a table of ``df``'s first LISTED rows in order; numbers stand on the right."""
    first = df.orderBy(*order).limit(LISTED)
    lines = [r.line for r in rows(first, fields).collect()]  # LISTED at most
    head = ["| " + " | ".join(titles or fields) + " |", "| " + " | ".join("---:" if f in numbers else "---" for f in fields) + " |"]
    more = df.count() - len(lines) if len(lines) == LISTED else 0
    return [*head, *lines, *([f"... and {more} more"] if more else [])]


def records(df: DataFrame) -> list[str]:
    """Verbalized records (kind, local_name, text), each under a heading."""
    out = ["# Verbalized Records", ""]
    for r in df.orderBy("kind", "local_name").limit(LISTED).collect():  # LISTED at most
        out += [f"## {r.kind}: {r.local_name}", "", r.text or "", ""]
    return out


def scenario(name: str, metrics: dict, failures: DataFrame) -> list[str]:
    """A run's report: its numbers, then the query pairs that failed (id, name, f1, sql_rows, graph_rows, cause)."""
    lines = [f"# Report: {name}", "", *[f"- {k}: {v}" for k, v in metrics.items()], "", "## Failed query pairs", ""]
    if failures.isEmpty():
        return [*lines, "No failed query pairs."]
    fields = ["id", "name", "f1", "sql_rows", "graph_rows", "cause"]
    return lines + table(failures, fields, ["id"], ["ID", "Name", "F1", "SQL rows", "Graph rows", "Likely cause"], ("f1", "sql_rows", "graph_rows"))


def summary(df: DataFrame) -> list[str]:
    """The report of reporting.summary(): how many scenarios stand where, then each of them."""
    by = {r.status: r.n for r in df.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row a status
    seconds = df.agg(F.sum("seconds")).first()[0] or 0.0
    lines = ["# Benchmark summary", "", *[f"- Scenarios {s}: {by.get(s, 0)}" for s in ("passed", "blocked", "pending")], f"- Seconds in total: {seconds:.2f}", "", "## Scenarios", ""]
    fields = ["scenario", "first_f1", "last_f1", "gain", "status", "runs", "seconds", "top_cause"]
    return lines + table(df, fields, ["scenario"], numbers=("first_f1", "last_f1", "gain", "runs", "seconds"))


def candidates(overall: DataFrame, by_scenario: DataFrame, best: DataFrame) -> list[str]:
    """The report on candidate generation: metrics over all scenarios, by scenario, and the best method of each."""
    fields = ["method", "k", "recall_at_k", "mrr", "candidate_coverage"]
    out = ["# Candidate generation", "", "## Overall", "", *table(overall, fields, ["method", "k"], numbers=fields[1:])]
    out += ["", "## By scenario", "", *table(by_scenario, ["scenario", *fields], ["scenario", "method", "k"], numbers=fields[1:])]
    return [*out, "", "## Best method per scenario", "", *table(best, ["scenario", "method", "recall", "difficult"], ["scenario"], numbers=("recall",))]


def comparison(df: DataFrame) -> list[str]:
    """The report of reporting.compare()."""
    fields = ["scenario", "f1", "baseline_f1", "delta", "decision"]
    return ["# Comparison", "", *table(df, fields, ["scenario"], numbers=("f1", "baseline_f1", "delta"))]


def write(lines: Sequence[str], path: str | Path) -> None:
    """Written beside and moved into place, so no half of a report is left."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(path.suffix + ".new")
    new.write_text("\n".join(lines).rstrip() + "\n", encoding="utf-8")
    new.replace(path)
