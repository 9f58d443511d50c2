"""Commands: ``python -m trelliq.cli <command> --scenario <folder> --work <folder>``."""

from __future__ import annotations

import argparse
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import decisions, markdown, reporting, retrieval, sampling
from .plans.compiler import Match, compile_rules
from .plans.graphquery import graph_query
from .plans.materialize import RulePlanner
from .scenario import Scenario, arguments, load, read_config
from .sources import files
from .sources.rdfxml import is_rdfxml, parse_rdfxml
from .sources.turtle import ontology_records, parse_turtle, triples_frame


def source_records(spark: SparkSession, s: Scenario) -> DataFrame:
    """A record for each class, attribute and link of the schema: id, kind, name and text."""
    rows = []
    for t in s.catalog.tables.values():
        if t.role != "join_table":
            rows.append((f"source-class:{t.name}", "class", t.name, f"class {t.name} {t.role}"))
        rows += [(f"source-data:{t.name}.{c}", "data_property", c, f"attribute {c} of {t.name}") for c in t.names if c not in t.fk_columns and c not in t.primary_key]
        rows += [(f"source-object:{t.name}.{','.join(fk.columns)}", "object_property", fk.columns[0], f"link from {t.name} to {fk.ref_table}") for fk in t.foreign_keys]
    return spark.createDataFrame(rows, "source string, kind string, name string, text string")


def target_records(spark: SparkSession, s: Scenario) -> DataFrame:
    text_ = s.ontology.read_text(encoding="utf-8")
    facts = triples_frame(spark, parse_rdfxml(text_) if is_rdfxml(text_) else parse_turtle(text_))
    return ontology_records(facts).withColumn("text", F.concat_ws(" ", "kind", "local_name", "label", "comment"))


def candidates(spark: SparkSession, s: Scenario, k: int) -> DataFrame:
    """Each source's best targets of its kind by name; ontologies are small, so kinds are joined whole."""
    t = target_records(spark, s).select("kind", F.col("uri").alias("target"), "local_name")
    flat = lambda c: F.array_join(text.tokens(F.col(c)), " ")
    scored = source_records(spark, s).join(t, "kind").withColumn("score", text.similarity(flat("name"), flat("local_name")))
    return retrieval.ranked(scored, "source", "target", F.col("score"), k).select("source", "kind", "target", "score", "rank")


def matches(spark: SparkSession, s: Scenario, k: int) -> list[Match]:
    """The offline decisions, with the targets' domains and ranges. Schemas are small, so they are driver rows."""
    chosen = decisions.FirstCandidate().decide(candidates(spark, s, k))
    t = target_records(spark, s).select(F.col("uri").alias("target"), "domain", "range")
    return [Match(r.source, r.target, tuple(r.domain or ()), tuple(r.range or ())) for r in chosen.join(t, "target", "left").orderBy("source").collect()]


def planned(spark: SparkSession, s: Scenario, k: int) -> RulePlanner:
    return RulePlanner(s.name, s.catalog, s.frames, compile_rules(matches(spark, s, k), s.catalog))


def evaluate(spark: SparkSession, s: Scenario, triples: DataFrame) -> DataFrame:
    """Scores of every query pair; a text that fails to parse or run is an error."""
    from .operators import evaluation

    files.register_scenario(spark, s.frames)
    parts = []
    for p in s.pairs:
        one = evaluation.membership_scores(evaluation.render(graph_query(triples, p.sparql)), evaluation.render(files.run_sql(spark, p.sql)))
        parts.append(one.withColumn("query_id", F.lit(p.id)))
    return reduce(DataFrame.unionByName, parts)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trelliq", description=__doc__)
    parser.add_argument("command", choices=["devset", "verbalize", "retrieve", "match", "fol", "materialize", "evaluate", "run", "summarize"])
    parser.add_argument("--config", help="a YAML file with settings; its scenarios are run one after the other")
    parser.add_argument("--scenario", help="a scenario's folder; with --config the name of one of its scenarios")
    parser.add_argument("--work")
    parser.add_argument("--reports", action="store_true", help="write Markdown reports as well")
    parser.add_argument("--dry-run", action="store_true", help="print what a configuration would run")
    parser.add_argument("--top-k", type=int, default=16)
    parser.add_argument("--fraction", type=float, default=0.1)
    parser.add_argument("--seed", default="sample-v1")
    args = parser.parse_args(argv)
    if args.config:
        for line in arguments(read_config(args.config), args.command, args.scenario):
            print("trelliq", *line)
            if not args.dry_run:
                main(line)
        return
    if not args.scenario or not args.work:
        parser.error("--scenario and --work are needed without --config")
    spark = SparkSession.builder.getOrCreate()
    s, work = load(spark, args.scenario), Path(args.work)
    put = lambda df, name: df.write.mode("overwrite").parquet(str(work / name))
    if args.command == "devset":
        kept = sampling.closed_sample(s.catalog, s.frames, args.fraction, args.seed)
        for name, df in kept.items():
            files.write_copy(df, s.catalog, name, str(work / "devset" / name))
        put(sampling.sample_summary(s.frames, kept), "devset_summary")
    if args.command in ("verbalize", "run"):
        put(source_records(spark, s), "source_records")
        put(target_records(spark, s), "target_records")
        if args.reports:
            markdown.write(markdown.records(source_records(spark, s).select("kind", F.col("name").alias("local_name"), "text")), work / "source_records.md")
            markdown.write(markdown.records(target_records(spark, s)), work / "target_records.md")
    if args.command in ("retrieve", "run"):
        put(candidates(spark, s, args.top_k), "candidates")
    if args.command in ("match", "run"):
        put(decisions.FirstCandidate().decide(candidates(spark, s, args.top_k)), "matches")
    if args.command in ("fol", "run"):
        from .plans.rules import rules_frame

        put(rules_frame(spark, [r for _, r in planned(spark, s, args.top_k).rules]), "rules")
    if args.command in ("materialize", "run"):
        p = planned(spark, s, args.top_k)
        put(p.graph(), "triples")
        put(p.stats(), "rule_stats")
        files.write_n_triples(spark.read.parquet(str(work / "triples")), str(work / "graph.nt"))
    if args.command in ("evaluate", "run"):
        put(evaluate(spark, s, spark.read.parquet(str(work / "triples"))), "metrics")
        if args.reports:
            scores = spark.read.parquet(str(work / "metrics"))
            mean = scores.agg(F.avg("f1")).first()[0]
            failed = scores.filter("f1 < 1").select(F.col("query_id").alias("id"), F.col("query_id").alias("name"), "f1", F.col("n_reference").alias("sql_rows"), F.col("n_answer").alias("graph_rows"), reporting.likely_cause(F.col("n_reference"), F.col("n_answer")).alias("cause"))
            markdown.write(markdown.scenario(s.name, {"F1": mean, "facts": spark.read.parquet(str(work / "triples")).count()}, failed), work / "report.md")
    if args.command == "summarize":
        made = reporting.summary(spark.read.parquet(str(work / "ledger")))
        put(made, "summary")
        if args.reports:
            markdown.write(markdown.summary(made), work / "summary.md")


if __name__ == "__main__":
    main()
