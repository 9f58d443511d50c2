"""val_*: reachability, facts, answers, and decisions on runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging
from ..operators import validation as ops
from ..operators.decisions import Recorded
from ..plans import materialize
from .base import STAR_SQL, cls, filtered, planner, register, star_triples, table
from .corpus import RUNS, ask

REGISTRY: dict = {}


@register(REGISTRY, "val_reach_direct", "SELECT count(*) AS row_count, count(*) FILTER (o_orderstatus <> 'P') AS nonempty_rows, count(*) FILTER (o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS hit_rows FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_custkey AS STRING) END"))
    return ops.direct_reachability(orders, ["o_custkey"], table(spark, d, "customer").filter("c_acctbal < 0"), ["c_custkey"])


_A, _B = "(l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))", "(l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25))"


@register(REGISTRY, "val_reach_assoc", f"SELECT count(*) AS nonempty_rows, count(*) FILTER ({_A}) AS subject_hits, count(*) FILTER ({_B}) AS object_hits, count(*) FILTER ({_A} AND {_B}) AS both_hits FROM lineitem")
def _(spark, d):
    return ops.association_reachability(table(spark, d, "lineitem"), ("l_orderkey", table(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_orderkey"), ("l_partkey", table(spark, d, "part").filter("p_size < 25"), "p_partkey"))


@register(REGISTRY, "val_graph_counts", f"WITH g AS (SELECT DISTINCT * FROM ({STAR_SQL})) SELECT o AS iri, 'class' AS role, count(*) AS triples, count(DISTINCT s) AS subjects, 0 AS objects FROM g WHERE p LIKE '%#type' GROUP BY o UNION ALL SELECT p, 'predicate', count(*), count(DISTINCT s), count(DISTINCT o) FROM g GROUP BY p")
def _(spark, d):
    return materialize.graph_counts(star_triples(spark, d)).withColumn("objects", F.col("objects").cast("int"))


@register(REGISTRY, "val_vectors", "SELECT vec_id, 'dimension_mismatch' AS issue FROM embeddings WHERE label = 3")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return ops.vector_issues(e, "vec_id", "embedding", 64)


@register(REGISTRY, "val_runtime_score", "SELECT 1 AS emitting_rules, 1 AS failing_rules, count(*) FILTER (event_type = 'click') AS emitted, count(*) FILTER (event_type <> 'click') AS failures FROM events")
def _(spark, d):
    stats = planner(spark, d, [cls("events", "Click", row_filter=filtered("event_type", equals="click"))]).stats()
    ok = F.col("outcome") == "emitted"
    return stats.agg(F.count_distinct(F.when(ok, F.col("rule_id"))).cast("int").alias("emitting_rules"), F.count_distinct(F.when(~ok, F.col("rule_id"))).cast("int").alias("failing_rules"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("emitted"), F.sum(F.when(ok, 0).otherwise(F.col("n"))).alias("failures"))


# --- facts and answers -------------------------------------------------------------------------------------------------

_FACTS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'urn:a' WHEN 1 THEN 'http://a' WHEN 2 THEN 'a' ELSE 'https://a/' || event_type END AS s, CASE user_id % 3 WHEN 0 THEN 'p' ELSE 'urn:p' END AS p, CASE event_id % 5 WHEN 0 THEN 'b c' WHEN 1 THEN 'urn:b' ELSE event_type END AS o, user_id % 2 = 0 AS is_literal FROM events"
_URI = "regexp_matches({}, '^(http://|https://|urn:)')"


@register(
    REGISTRY,
    "val_invalid_triples",
    "SELECT s, p, o, reason, count(*) AS n FROM (SELECT s, p, o, unnest([" + ", ".join(f"CASE WHEN {t} THEN 'invalid_{n}' END" for n, t in (("subject", f"NOT {_URI.format('s')}"), ("predicate", f"NOT {_URI.format('p')}"), ("object", f"NOT is_literal AND NOT {_URI.format('o')}"))) + f"]) AS reason FROM ({_FACTS})) WHERE reason IS NOT NULL GROUP BY ALL",
)
def _(spark, d):
    return materialize.invalid_triples(ask(spark, d, _FACTS).drop("event_id")).groupBy("s", "p", "o", "reason").agg(F.count("*").alias("n"))


#: Answers to one request a customer: good ones, no JSON, another source, a target not offered, odd confidences, none or two.
_ONE = "'{\"source_id\":\"' || CASE WHEN c_custkey % 11 = 0 THEN 's0x' ELSE 's' || CAST(c_custkey AS STRING) END || '\",\"target_uri\":' || CASE WHEN c_custkey % 7 = 0 THEN 'null' ELSE '\"u' || CAST(c_custkey % 5 AS STRING) || '\"' END || ',\"confidence\":' || CASE WHEN c_custkey % 13 = 0 THEN '1.5' ELSE '0.5' END || '}'"
_SAID = f"SELECT 's' || CAST(c_custkey AS STRING) AS source_id, c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 'no json' WHEN c_custkey % 19 = 0 THEN '{{\"matches\":[]}}' WHEN c_custkey % 6 = 0 THEN '{{\"matches\":[' || {_ONE} || ',' || {_ONE} || ']}}' ELSE '{{\"matches\":[' || {_ONE} || ']}}' END AS body FROM customer"
_OFFERED = "SELECT 's' || CAST(c_custkey AS STRING) AS source_id, 'u1' AS target FROM customer UNION ALL SELECT 's' || CAST(c_custkey AS STRING), 'u2' FROM customer WHERE c_custkey % 2 = 0"
_THERE = "k % 17 <> 0 AND k % 19 <> 0"


@register(
    REGISTRY,
    "val_contract",
    "SELECT source_id, issue FROM (SELECT source_id, unnest([CASE WHEN k % 17 = 0 THEN 'invalid_json' END, CASE WHEN k % 17 <> 0 AND (k % 19 = 0 OR k % 6 = 0) THEN 'not_one_decision' END, "
    f"CASE WHEN {_THERE} AND k % 11 = 0 THEN 'source_id_mismatch' END, CASE WHEN {_THERE} AND k % 7 <> 0 AND NOT (k % 5 = 1 OR (k % 5 = 2 AND k % 2 = 0)) THEN 'target_not_offered' END, CASE WHEN {_THERE} AND k % 13 = 0 THEN 'confidence_out_of_range' END]) AS issue FROM (SELECT 's' || c_custkey AS source_id, c_custkey AS k FROM customer)) WHERE issue IS NOT NULL",
)
def _(spark, d):
    return ops.contract_issues(ask(spark, d, _SAID).select("source_id", "body"), ask(spark, d, _OFFERED))


_CHOICES = "SELECT DISTINCT o_custkey AS source, o_orderpriority AS target FROM orders"
_DECIDED = "SELECT c_custkey AS source, CASE c_custkey % 6 WHEN 0 THEN ' No_Match ' WHEN 1 THEN NULL WHEN 2 THEN '1-URGENT' WHEN 3 THEN '5-LOW' WHEN 4 THEN 'unheard of' ELSE 'none' END AS target, c_custkey % 10 / 10.0 AS confidence FROM customer"


@register(REGISTRY, "val_decisions", f"SELECT source, CASE WHEN ok THEN target END AS target, CASE WHEN ok THEN round(confidence, 6) ELSE 0 END::DOUBLE AS confidence FROM (SELECT *, (source, target) IN ({_CHOICES.replace('SELECT DISTINCT o_custkey AS source, o_orderpriority AS target', 'SELECT (o_custkey, o_orderpriority)')}) AS ok FROM ({_DECIDED})) WHERE source IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    said = ask(spark, d, _DECIDED).withColumn("confidence", F.col("confidence").cast("double"))
    return Recorded(said).decide(ask(spark, d, _CHOICES)).withColumn("confidence", F.round("confidence", 6))


_ITEMS = "SELECT o_custkey AS source_id, o_orderpriority AS target, o_orderkey % 3 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 3 - o_orderkey % 3 END AS reasons FROM orders WHERE o_orderkey % 3 = 0"


@register(
    REGISTRY,
    "val_shortlist",
    f"SELECT source_id, issue FROM (SELECT source_id, unnest([CASE WHEN n = 0 THEN 'empty_shortlist' END, CASE WHEN n > 3 THEN 'too_many_items' END, CASE WHEN u < n THEN 'repeated_item' END, CASE WHEN odd > 0 THEN 'wrong_reason_count' END]) AS issue FROM (SELECT c_custkey AS source_id, count(target) AS n, count(DISTINCT target) AS u, count(*) FILTER (reasons <> 3) AS odd FROM customer LEFT JOIN ({_ITEMS}) ON source_id = c_custkey GROUP BY 1)) WHERE issue IS NOT NULL",
)
def _(spark, d):
    items = ask(spark, d, _ITEMS).select("source_id", F.struct("target", F.array_repeat(F.lit("why"), F.col("reasons").cast("int")).alias("reasons")).alias("item"))
    lists = items.groupBy("source_id").agg(F.collect_list("item").alias("items"))
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    empty = F.array().cast("array<struct<target:string,reasons:array<string>>>")
    return ops.shortlist_issues(everyone.join(lists, "source_id", "left").withColumn("items", F.coalesce("items", empty)))


# --- decisions on repairs and runs ---------------------------------------------------------------------------------------

#: A proposed repair for each order: what it had before and after.
_REPAIRS = (
    "SELECT k, a % 9 AS issues_before, (a + b) % 9 AS issues_after, a % 4 AS class_before, b % 4 AS class_after, b % 5 AS data_before, c AS data_after, e AS object_before, a % 3 AS object_after, CASE WHEN k % 10 = 0 THEN 0 ELSE 5 END AS selected, "
    "'r' || CAST(a % 6 AS STRING) AS class_text_before, 'r' || CAST(a % 3 AS STRING) AS class_text_after, CASE WHEN e = 0 THEN NULL ELSE 'd' END AS data_text_before, CASE WHEN e < 2 THEN NULL ELSE 'd' END AS data_text_after, b AS object_issues_before, c AS object_issues_after, "
    "CASE WHEN a % 11 = 0 THEN 2 ELSE 0 END AS target_not_in_selected_matches, CASE WHEN a % 13 = 0 THEN 1 ELSE 0 END AS missing_match_ids, 0 AS match_ids_do_not_reference_selected_matches, CASE WHEN b = 1 THEN 1 ELSE 0 END AS dropped_class_targets, 0 AS dropped_data_targets, e AS dropped_object_targets, "
    f"CASE WHEN c = 3 THEN 1 ELSE 0 END AS dropped_filters, c AS dropped_groundings, b AS protected_object_targets FROM ({RUNS}) runs"
)
_T0, _T1 = "(class_before + data_before + object_before)", "(class_after + data_after + object_after)"
_BASE = [
    ("validation_issue_count_worse", "issues_after > issues_before"), ("repaired_fol_removed_all_rules", f"{_T0} > 0 AND {_T1} = 0"), ("selected_matches_but_no_repaired_rules", f"selected > 0 AND {_T1} = 0"), ("repaired_rule_count_below_50_percent", f"{_T0} > 0 AND {_T1} * 2 < {_T0}"),
    *[(f"repaired_fol_removed_{k}_rules", f"{k}_before > 0 AND {k}_after = 0") for k in judging.KINDS],
]
_OBJECT = [*_BASE, *[(f"targeted_object_repair_modified_{k}_rules", f"{k}_text_before IS DISTINCT FROM {k}_text_after") for k in ("class", "data")], ("targeted_object_issue_count_worse", "object_issues_after > object_issues_before")]
_KEEP = [
    *_BASE, *[(f"critical_fol_issue_after_repair:{n}", f"{n} > 0") for n in judging.CRITICAL_ISSUES], *[(f"preservation_gate_dropped_selected_{k}_targets", f"dropped_{k}_targets > 0") for k in judging.KINDS],
    ("preservation_gate_dropped_filtered_class_rules", "dropped_filters > 0"), ("preservation_gate_changed_object_grounding", "dropped_groundings > 0 AND protected_object_targets > 0"),
]


def _reasons_sql(tests, rel, key="k"):
    why = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests) + "], lambda x: x IS NOT NULL)"
    return f"SELECT {key}, len(w) = 0 AS accepted, array_to_string(w, ',') AS reasons FROM (SELECT *, {why} AS w FROM ({rel}))"


for _name, _sql, _tests in (("val_acceptance", _BASE, judging.repair_tests), ("val_object_acceptance", _OBJECT, judging.object_repair_tests), ("val_preservation", _KEEP, judging.preservation_tests)):

    @register(REGISTRY, _name, _reasons_sql(_sql, _REPAIRS))
    def _(spark, d, tests=_tests):
        return judging.decided(ask(spark, d, _REPAIRS), ["k"], tests())


_COUNTERS = ("invalid_triple_count", "zero_emission_selected_targets", "unknown_reference_issues", "fk_like_literal_issues", "overbroad_issues", "selected_targets_with_emission", "generated_triples")
_COVERED = f"SELECT k, {', '.join(f'({v}) AS {n}_{w}' for w, f in (('before', 'a'), ('after', 'b')) for n, v in zip(_COUNTERS, (f'{f} % 2', f'({f} + k) % 3', 'e', f'{f} % 4', 'c', f'{f} + 3', f'({f} * 37) % 400'), strict=True))} FROM ({RUNS}) runs"
_DOWN = ("invalid_triple_count", "zero_emission_selected_targets", "unknown_reference_issues", "fk_like_literal_issues", "overbroad_issues")


def _score_sql(w):
    return "row(" + ", ".join([f"-{n}_{w}" for n in _DOWN] + [f"selected_targets_with_emission_{w}", f"generated_triples_{w}"]) + ")"


@register(
    REGISTRY,
    "val_coverage_acceptance",
    _reasons_sql([("invalid_triple_count_worse", "invalid_triple_count_after > invalid_triple_count_before"), ("generated_triples_collapsed", "generated_triples_before > 0 AND generated_triples_after < 0.5 * generated_triples_before"), ("overbroad_issue_count_worse", "overbroad_issues_after > overbroad_issues_before"), ("internal_materialization_score_worse", f"{_score_sql('after')} < {_score_sql('before')}")], _COVERED),
)
def _(spark, d):
    return judging.decided(ask(spark, d, _COVERED), ["k"], judging.coverage_repair_tests())


_CODE = f"SELECT k, scenario, a % 5 <> 0 AS static_ok_after, b <> 1 AS execution_ok_after, {', '.join(f'({v}) AS {n}_{w}' for w, f in (('before', 'a'), ('after', 'b')) for n, v in (('invalid', f'{f} % 3'), ('skipped_reachable', f'{f} % 2'), ('reachable_zero', f'({f} + c) % 4'), ('generated', f'({f} * 17) % 90'), ('score', f'({f} * 13) % 50')))} FROM ({RUNS}) runs"


@register(REGISTRY, "val_code_repair", f"SELECT k, static_ok_after AND execution_ok_after AND (generated_before = 0 OR generated_after >= 0.5 * generated_before) AND invalid_after <= invalid_before AND skipped_reachable_after <= skipped_reachable_before AND reachable_zero_after <= reachable_zero_before AND score_after >= score_before AS accepted FROM ({_CODE})")
def _(spark, d):
    return ask(spark, d, _CODE).select("k", judging.code_repair_accepted().alias("accepted"))


_PROGRAMS = f"SELECT scenario, k, b <> 1 AS execution_ok, a % 3 % 2 AS invalid, c % 2 AS skipped_reachable, a % 4 AS covered_kinds, CASE WHEN e = 0 THEN 0 ELSE 3 END AS expected_kinds, (a * 31) % 500 AS generated, b AS reachable_zero, 20 + c AS lines FROM ({RUNS}) runs"
_RUNTIME = "row(CASE WHEN execution_ok AND invalid = 0 AND skipped_reachable = 0 THEN 1 ELSE 0 END, CASE WHEN expected_kinds = 0 THEN 1 ELSE covered_kinds / expected_kinds END, generated, -reachable_zero, -invalid, -lines)"


@register(REGISTRY, "val_best_program", f"SELECT scenario, k FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {_RUNTIME} DESC, k) AS r FROM ({_PROGRAMS})) WHERE r = 1")
def _(spark, d):
    score = F.max_by("k", F.struct(judging.runtime_score().alias("s"), (-F.col("k")).alias("first")))
    return ask(spark, d, _PROGRAMS).groupBy("scenario").agg(score.alias("k"))


_CHOSEN = f"SELECT scenario, k, a % 5 AS rejected, b % 3 AS uri_issues, c % 2 AS invalid, {', '.join(f'({v}) AS {n}' for n, v in zip(_COUNTERS, ('a % 2', 'b % 3', 'e', 'a % 4', 'c', 'a + 3', '(b * 37) % 400'), strict=True))}, a % 6 AS class_rules, b AS data_rules, c AS object_rules FROM ({RUNS}) runs"


@register(
    REGISTRY,
    "val_best_patterns",
    f"SELECT scenario, k FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY -rejected DESC, -uri_issues DESC, -invalid DESC, -zero_emission_selected_targets DESC, class_rules + data_rules + object_rules DESC, selected_targets_with_emission + generated_triples - {' - '.join(_DOWN)} DESC, k) AS r FROM ({_CHOSEN})) WHERE r = 1",
)
def _(spark, d):
    score = F.max_by("k", F.struct(judging.pattern_score().alias("s"), (-F.col("k")).alias("first")))
    return ask(spark, d, _CHOSEN).groupBy("scenario").agg(score.alias("k"))


_CANDIDATES = (
    "SELECT scenario, arm, k, a % 23 <> 0 AS import_exists, (a % 40) * 25 AS generated_triples, CASE WHEN a % 7 = 3 THEN 1 ELSE 0 END AS invalid_triples, CASE c WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' WHEN 2 THEN '' ELSE 'success' END AS status, CASE WHEN a % 17 = 0 THEN 1 ELSE 0 END AS prefixed_targets, CASE WHEN a % 19 = 0 THEN 2 ELSE 0 END AS target_not_in_selected_matches, "
    "CASE WHEN b = 6 THEN 'TypeError: x' WHEN b = 5 THEN NULL ELSE '' END AS error, a % 2 AS critical_issues, b AS selected_targets_with_emission, e AS zero_emission_selected_targets, c % 2 AS unknown_reference_issues, a % 3 AS overbroad_issues, b % 2 AS fk_like_literal_issues, c AS zero_rule_issues, a % 4 AS class_rules, b % 3 AS data_rules, c % 3 AS object_rules, a % 5 AS issues_after "
    f"FROM ({RUNS}) runs"
)
_HARD = [("missing_import_ttl", "NOT import_exists"), ("zero_generated_triples", "generated_triples <= 0"), ("invalid_triples", "invalid_triples > 0"), ("materialization_status_not_success", "status <> '' AND status NOT IN ('success', 'ok')"), ("role_prefixed_target_uri", "prefixed_targets > 0"), ("invented_target_uri", "target_not_in_selected_matches > 0"), ("codegen_or_materialization_error", "coalesce(error, '') <> ''")]


@register(REGISTRY, "val_hard_rejections", _reasons_sql(_HARD, _CANDIDATES).replace("len(w) = 0 AS accepted, ", ""))
def _(spark, d):
    return ask(spark, d, _CANDIDATES).select("k", F.array_join(judging.hard_rejections(), ",").alias("reasons"))


#: Places of arms where all else is equal.
_PLACES = {"hybrid0": 0, "hybrid1": 0, "round20": 1, "round21": 1, "default0": 2}
_PLACED = " ".join(f"WHEN '{a}' THEN {n}" for a, n in _PLACES.items())
_VALID_RUNS = f"SELECT * FROM ({_CANDIDATES}) WHERE NOT ({' OR '.join(t for _, t in _HARD)})"
_SANE = "CASE WHEN median > 0 THEN -CAST(round_even(abs(generated_triples - median) / greatest(1, median) * 20, 0) AS INT) ELSE 0 END"


@register(
    REGISTRY,
    "val_portfolio_select",
    f"SELECT scenario, arm, sanity AS triple_sanity, median FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY sanity DESC, critical_issues, selected_targets_with_emission DESC, zero_emission_selected_targets, unknown_reference_issues, overbroad_issues, fk_like_literal_issues, zero_rule_issues, "
    f"(class_rules > 0)::INT + (data_rules > 0)::INT + (object_rules > 0)::INT DESC, issues_after, CASE arm {_PLACED} ELSE 99 END, arm) AS r FROM (SELECT *, {_SANE} AS sanity FROM (SELECT v.*, CAST(round_even(m.median, 0) AS BIGINT) AS median FROM ({_VALID_RUNS}) v JOIN (SELECT scenario, median(generated_triples) AS median FROM ({_VALID_RUNS}) GROUP BY 1) m USING (scenario)))) WHERE r = 1",
)
def _(spark, d):
    return judging.chosen_runs(ask(spark, d, _CANDIDATES), "scenario", "arm", _PLACES)
