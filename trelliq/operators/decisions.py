"""Decisions that an external matcher would take, as tables: first candidate, recorded ones, overrides."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class DecisionProvider(Protocol):
    def decide(self, candidates: DataFrame) -> DataFrame:
        """(source, target, confidence) for each source of (source, target, rank)."""


class FirstCandidate:
    """The best-ranked candidate, with confidence one half."""

    def decide(self, candidates: DataFrame) -> DataFrame:
        return candidates.filter("rank = 1").select("source", "target", F.lit(0.5).alias("confidence"))


class Recorded:
    """Decisions from a table; a target outside the source's candidates, or a word for none, is no match."""

    NONE = ("", "null", "none", "no_match", "n/a")

    def __init__(self, decisions: DataFrame):
        self.decisions = decisions

    def decide(self, candidates: DataFrame) -> DataFrame:
        said = self.decisions.withColumn("target", F.when(~F.lower(F.trim(F.coalesce("target", F.lit("")))).isin(*self.NONE), F.col("target")))
        known = candidates.select("source").distinct()
        allowed = candidates.select("source", "target", F.lit(True).alias("_ok"))
        out = said.join(known, "source", "left_semi").join(allowed, ["source", "target"], "left")
        return out.select("source", F.when(F.col("_ok"), F.col("target")).alias("target"), F.when(F.col("_ok"), F.col("confidence")).otherwise(0.0).alias("confidence"))


class Override:
    """Another provider's decisions, replaced where a table names the source."""

    def __init__(self, inner: DecisionProvider, overrides: DataFrame):
        self.inner, self.overrides = inner, overrides

    def decide(self, candidates: DataFrame) -> DataFrame:
        o = self.overrides.select("source", F.col("target").alias("_forced"))
        out = self.inner.decide(candidates).join(o, "source", "left")
        return out.select("source", F.coalesce("_forced", "target").alias("target"), F.when(F.col("_forced").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))


class Reviewed:
    """Three passes: what the first provider matched is decided again by the review, and what has no match then by the referee."""

    def __init__(self, first: DecisionProvider, review: DecisionProvider, referee: DecisionProvider):
        self.first, self.review, self.referee = first, review, referee

    def decide(self, candidates: DataFrame) -> DataFrame:
        said = self.first.decide(candidates)
        for provider, test in ((self.review, "target IS NOT NULL"), (self.referee, "target IS NULL")):
            again = provider.decide(candidates.join(said.filter(test).select("source"), "source", "left_semi"))
            again = again.select("source", F.col("target").alias("_t"), F.col("confidence").alias("_c"), F.lit(True).alias("_asked"))
            out = said.join(again, "source", "left")
            asked = F.expr(test) & F.coalesce("_asked", F.lit(False))
            said = out.select("source", F.when(asked, F.col("_t")).otherwise(F.col("target")).alias("target"), F.when(asked, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"))
        return said


class Voted:
    """Several providers' decisions, of which the one with most votes holds: ties by mean confidence, rank, a match before none, name."""

    def __init__(self, *providers: DecisionProvider):
        self.providers = providers

    def decide(self, candidates: DataFrame) -> DataFrame:
        said = self.providers[0].decide(candidates)
        for p in self.providers[1:]:
            said = said.unionByName(p.decide(candidates))
        votes = said.groupBy("source", "target").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
        votes = votes.join(candidates.select("source", "target", "rank"), ["source", "target"], "left")
        w = Window.partitionBy("source").orderBy(F.desc("n"), F.desc(F.round("c", 9)), F.coalesce("rank", F.lit(1 << 30)), F.col("target").isNull(), "target")
        best = votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        return best.select("source", "target", F.when(F.col("target").isNotNull(), F.col("c")).otherwise(0.0).alias("confidence"))


class Shortlisted:
    """Two stages: a table names each source's shortlist, and another provider chooses from it. Shortlists that break their rules count as none."""

    def __init__(self, shortlists: DataFrame, chooser: DecisionProvider):
        self.shortlists, self.chooser = shortlists, chooser

    def decide(self, candidates: DataFrame) -> DataFrame:
        from .validation import shortlist_issues

        good = self.shortlists.join(shortlist_issues(self.shortlists).select("source_id").distinct(), "source_id", "left_anti")
        named = good.select(F.col("source_id").alias("source"), F.explode("items.target").alias("target"))
        chosen = self.chooser.decide(candidates.join(named, ["source", "target"], "left_semi"))
        every = candidates.select("source").distinct()
        return every.join(chosen, "source", "left").select("source", "target", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def judged_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """source, decision, error_type, predicted, candidate_rank, confidence of answers to requests.

    answers: source, asked (number of decisions in the answer), said_source, target, confidence, failed. An answer that
    failed is an api_error; one without exactly one decision, for another source, or of a target that wasn't offered is
    invalid; a word for none is no match.
    """
    none = F.lower(F.trim(F.coalesce("target", F.lit("")))).isin(*Recorded.NONE)
    a = answers.withColumn("target", F.when(~none, F.col("target"))).join(candidates.select("source", "target", "rank"), ["source", "target"], "left")
    error = F.when(F.col("failed"), "api_error").when((F.col("asked") != 1) | ~F.coalesce(F.col("said_source") == F.col("source"), F.lit(False)), "missing_source_id").when(F.col("target").isNotNull() & F.col("rank").isNull(), "invalid_target_uri").otherwise("")
    a = a.withColumn("error_type", error)
    good = F.col("error_type") == ""
    decision = F.when(F.col("error_type") == "api_error", "api_error").when(~good, "invalid").when(F.col("target").isNull(), "no_match").otherwise("selected")
    return a.select("source", decision.alias("decision"), "error_type", F.when(good, F.col("target")).alias("predicted"), F.when(good, F.col("rank")).alias("candidate_rank"), F.when(good, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"))


def load_artifact(artifact: DataFrame, sources: DataFrame, records: DataFrame, k: int, **provenance: str) -> DataFrame:
    """source, rank, target and the target's record: the first k candidates of an artifact whose rows all have the given provenance.

    artifact: source, rank, target and the provenance's columns. A row of another provenance, and a source without a row,
    are errors.
    """
    a = artifact
    for name, wanted in provenance.items():
        told = F.raise_error(F.concat(F.lit(f"{name} is missing or incompatible: "), F.coalesce(F.col(name), F.lit("none")))).cast("string")
        a = a.withColumn(name, F.when(F.col(name) == wanted, F.col(name)).otherwise(told))
    there = a.select("source", *provenance).distinct()
    checked = sources.join(there, "source", "left")
    first = next(iter(provenance))
    lost = F.raise_error(F.concat(F.lit("no artifact row for "), F.col("source").cast("string"))).cast("string")
    checked = checked.withColumn("_ok", F.when(F.col(first).isNull(), lost).otherwise(F.col(first)))
    return checked.filter(F.col("_ok").isNotNull()).select("source").join(a.select("source", "rank", "target").filter(F.col("rank") <= k), "source").join(records, "target")


def chunks(df: DataFrame, group: str, order: str, size: int = 12) -> DataFrame:
    """Numbers rows of a group in chunks of ``size``."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))
