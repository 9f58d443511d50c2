"""Scores of candidate runs and decisions on repairs: expressions over a row a run, so any number of runs is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Issues that no repair may leave, and names of reasons for a rejection.
CRITICAL_ISSUES = ("target_not_in_selected_matches", "missing_match_ids", "match_ids_do_not_reference_selected_matches")
KINDS = ("class", "data", "object")


def _reasons(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())


def total(tag: str) -> Column:
    return F.col(f"class_{tag}") + F.col(f"data_{tag}") + F.col(f"object_{tag}")


def repair_tests() -> dict[str, Column]:
    """Why a repair of rules isn't taken: issues_, class_, data_ and object_ (numbers of rules) before and after, selected matches."""
    before, after = total("before"), total("after")
    tests = {
        "validation_issue_count_worse": F.col("issues_after") > F.col("issues_before"),
        "repaired_fol_removed_all_rules": (before > 0) & (after == 0),
        "selected_matches_but_no_repaired_rules": (F.col("selected") > 0) & (after == 0),
        "repaired_rule_count_below_50_percent": (before > 0) & (after * 2 < before),
    }
    return tests | {f"repaired_fol_removed_{k}_rules": (F.col(f"{k}_before") > 0) & (F.col(f"{k}_after") == 0) for k in KINDS}


def object_repair_tests() -> dict[str, Column]:
    """Besides, of a repair of object rules alone: class_text and data_text before and after, object issues."""
    changed = {f"targeted_object_repair_modified_{k}_rules": ~F.col(f"{k}_text_before").eqNullSafe(F.col(f"{k}_text_after")) for k in ("class", "data")}
    return repair_tests() | changed | {"targeted_object_issue_count_worse": F.col("object_issues_after") > F.col("object_issues_before")}


def preservation_tests() -> dict[str, Column]:
    """Besides, of a repair that must keep what was selected: critical issues by name, dropped targets by kind, filters, groundings."""
    critical = {f"critical_fol_issue_after_repair:{n}": F.col(n) > 0 for n in CRITICAL_ISSUES}
    dropped = {f"preservation_gate_dropped_selected_{k}_targets": F.col(f"dropped_{k}_targets") > 0 for k in KINDS}
    kept = {"preservation_gate_dropped_filtered_class_rules": F.col("dropped_filters") > 0, "preservation_gate_changed_object_grounding": (F.col("dropped_groundings") > 0) & (F.col("protected_object_targets") > 0)}
    return repair_tests() | critical | dropped | kept


def internal_score(tag: str = "") -> Column:
    """Seven numbers of a run's facts, better ones larger: struct columns compare in order."""
    c = lambda n: F.col(f"{n}{tag}")
    down = ("invalid_triple_count", "zero_emission_selected_targets", "unknown_reference_issues", "fk_like_literal_issues", "overbroad_issues")
    return F.struct(*[(-c(n)).alias(n) for n in down], *[c(n).alias(n) for n in ("selected_targets_with_emission", "generated_triples")])


def coverage_repair_tests() -> dict[str, Column]:
    """Why a repair for coverage isn't taken: the counters before and after."""
    b, a = (lambda n: F.col(f"{n}_before")), (lambda n: F.col(f"{n}_after"))
    return {
        "invalid_triple_count_worse": a("invalid_triple_count") > b("invalid_triple_count"),
        "generated_triples_collapsed": (b("generated_triples") > 0) & (a("generated_triples") < 0.5 * b("generated_triples")),
        "overbroad_issue_count_worse": a("overbroad_issues") > b("overbroad_issues"),
        "internal_materialization_score_worse": internal_score("_after") < internal_score("_before"),
    }


def decided(rows: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """key, accepted and the reasons against, joined by commas."""
    out = rows.withColumn("_r", _reasons(tests))
    return out.select(*key, (F.size("_r") == 0).alias("accepted"), F.array_join("_r", ",").alias("reasons"))


def runtime_score() -> Column:
    """Six numbers of a program's run: safe or not, share of expected kinds that it called, facts, rules without facts, invalid facts, lines."""
    safe = F.col("execution_ok") & (F.col("invalid") == 0) & (F.col("skipped_reachable") == 0)
    share = F.coalesce(F.try_divide(F.col("covered_kinds").cast("double"), F.col("expected_kinds").cast("double")), F.lit(1.0))
    return F.struct(safe.cast("double").alias("safe"), share.alias("helper_coverage"), F.col("generated").cast("double").alias("generated"), (-F.col("reachable_zero")).cast("double").alias("reachable_zero"), (-F.col("invalid")).cast("double").alias("invalid"), (-F.col("lines")).cast("double").alias("lines"))


def pattern_score() -> Column:
    """Six numbers of a selection of patterns."""
    parts = {"rejected": -F.col("rejected"), "uri_issues": -F.col("uri_issues"), "invalid": -F.col("invalid"), "zero": -F.col("zero_emission_selected_targets"), "rules": F.col("class_rules") + F.col("data_rules") + F.col("object_rules")}
    whole = F.col("selected_targets_with_emission") + F.col("generated_triples")
    for n in ("invalid_triple_count", "zero_emission_selected_targets", "unknown_reference_issues", "fk_like_literal_issues", "overbroad_issues"):
        whole = whole - F.col(n)
    return F.struct(*[v.alias(k) for k, v in parts.items()], whole.alias("materialization"))


def code_repair_accepted() -> Column:
    """Whether a repaired program replaces the one before: it runs, keeps half the facts, makes nothing worse, scores no less."""
    b, a = (lambda n: F.col(f"{n}_before")), (lambda n: F.col(f"{n}_after"))
    no_worse = (a("invalid") <= b("invalid")) & (a("skipped_reachable") <= b("skipped_reachable")) & (a("reachable_zero") <= b("reachable_zero"))
    return a("static_ok") & a("execution_ok") & ((b("generated") == 0) | (a("generated") >= 0.5 * b("generated"))) & no_worse & (a("score") >= b("score"))


def hard_rejections() -> Column:
    """Why a run can't be chosen at all: seven tests."""
    return _reasons(
        {
            "missing_import_ttl": ~F.col("import_exists"),
            "zero_generated_triples": F.col("generated_triples") <= 0,
            "invalid_triples": F.col("invalid_triples") > 0,
            "materialization_status_not_success": (F.col("status") != "") & ~F.col("status").isin("success", "ok"),
            "role_prefixed_target_uri": F.col("prefixed_targets") > 0,
            "invented_target_uri": F.col("target_not_in_selected_matches") > 0,
            "codegen_or_materialization_error": F.coalesce(F.col("error"), F.lit("")) != "",
        }
    )


def median_int(column: str) -> Column:
    """The middle value; of an even number the mean of both middle ones, halves to the even integer."""
    return F.bround(F.percentile(column, 0.5)).cast("long")


def chosen_runs(runs: DataFrame, scenario: str, arm: str, priority: dict[str, int]) -> DataFrame:
    """scenario, arm, triple_sanity and median of the best run of each scenario; scenarios without a valid run have none.

    Eleven numbers decide in order: distance of the facts to the median of valid runs in steps of 5 %, critical issues,
    targets with and without facts, unknown references, overbroad, key literals, rules without facts, kinds of rules,
    issues, and the arm's place.
    """
    valid = runs.withColumn("_why", hard_rejections()).filter(F.size("_why") == 0)
    mid = valid.groupBy(scenario).agg(median_int("generated_triples").alias("median"))
    away = F.abs(F.col("generated_triples") - F.col("median")) / F.greatest(F.lit(1), F.col("median"))
    sanity = F.when(F.col("median") > 0, -F.bround(away * 20).cast("int")).otherwise(0)
    place = F.coalesce(F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])[F.col(arm)], F.lit(99))
    kinds = sum((F.col(f"{k}_rules") > 0).cast("int") for k in KINDS)
    down = lambda n: -F.col(n)
    order = [sanity, down("critical_issues"), F.col("selected_targets_with_emission"), down("zero_emission_selected_targets"), down("unknown_reference_issues"), down("overbroad_issues"), down("fk_like_literal_issues"), down("zero_rule_issues"), kinds, down("issues_after"), -place]
    best = Window.partitionBy(scenario).orderBy(*[o.desc() for o in order], F.asc(arm))
    out = valid.join(mid, scenario).withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return out.select(scenario, arm, sanity.alias("triple_sanity"), "median")
