"""Coverage of selected matches by rules and by the facts that rules emitted; every issue is a row.

matches: source_id, target (null: none), table_name and column_name of data matches, match_type. rules: rule_id, kind,
source_table, source_column, columns (array of all columns that the rule reads), target, subject_table, match_ids.
columns: table_name, column_name, is_fk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of issues, and words in a table's or column's name that tell of text.
ATTRIBUTE_ISSUES = (
    "data_rule_unknown_source_table",
    "data_rule_unknown_source_column",
    "data_rule_target_not_selected",
    "literal_provenance_missing",
    "literal_provenance_too_broad",
    "fk_like_data_rule",
    "missing_data_rule",
    "fk_like_selected_datatype_match",
)
TEXT_WORDS = ("abstract", "comment", "description", "isbn", "issn", "keyword", "name", "review", "summary", "text", "title")


def _named(tests: dict[str, Column]) -> Column:
    """An array of the names of the tests that hold."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())


def _flag(keys: DataFrame, key: list[str], name: str) -> DataFrame:
    return keys.select(*key).distinct().withColumn(name, F.lit(True))


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def attribute_issues(rules: DataFrame, matches: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, issue) of data rules against the selected data matches, and of those matches against the rules.

    A rule supports a match if it names it, or has its table, column and target. A rule of an unknown table has that
    issue alone.
    """
    chosen = matches.filter("target IS NOT NULL")
    data = chosen.filter(F.col("source_id").startswith("source-data:"))
    r = rules.filter("kind = 'data'")
    named = r.select("rule_id", F.explode("match_ids").alias("source_id"))
    valid = _flag(named.join(chosen, "source_id", "left_semi"), ["rule_id"], "_valid")
    by_place = r.join(data.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), "target", "source_id"), ["source_table", "source_column", "target"])
    supports = named.join(data.select("source_id"), "source_id").select("rule_id", "source_id").unionByName(by_place.select("rule_id", "source_id")).distinct()
    tables = _flag(columns.withColumnRenamed("table_name", "source_table"), ["source_table"], "_table")
    place = columns.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.col("is_fk").alias("_fk"), F.lit(True).alias("_column"))
    full = r.join(tables, "source_table", "left").join(place, ["source_table", "source_column"], "left").join(_flag(data, ["target"], "_target"), "target", "left")
    full = full.join(valid, "rule_id", "left").join(_flag(supports, ["rule_id"], "_supports"), "rule_id", "left")
    known = _is("_table")
    found = _named(
        {
            "data_rule_unknown_source_table": ~known,
            "data_rule_unknown_source_column": known & ~_is("_column"),
            "data_rule_target_not_selected": known & (F.col("target") != "") & ~_is("_target"),
            "literal_provenance_missing": known & ~_is("_valid"),
            "literal_provenance_too_broad": known & _is("_valid") & ~_is("_supports"),
            "fk_like_data_rule": known & _is("_fk") & (F.coalesce("subject_table", F.lit("")) == ""),
        }
    )
    of_rules = full.select(F.col("rule_id").alias("id"), F.explode(found).alias("issue"))
    m = data.join(_flag(supports, ["source_id"], "_ruled"), "source_id", "left").join(columns.select("table_name", "column_name", F.col("is_fk").alias("_fk")), ["table_name", "column_name"], "left")
    of_matches = m.select(F.concat(F.lit("attribute:"), "source_id").alias("id"), F.explode(_named({"missing_data_rule": ~_is("_ruled"), "fk_like_selected_datatype_match": _is("_fk")})).alias("issue"))
    return of_rules.unionByName(of_matches)


def attribute_summary(rules: DataFrame, matches: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: selected data matches, those with and without rules, data rules on key columns, issues."""
    count = lambda name: F.count_if(F.col("issue") == name)
    chosen = matches.filter(F.col("target").isNotNull() & F.col("source_id").startswith("source-data:")).agg(F.count("*").alias("selected_datatype_matches"))
    found = attribute_issues(rules, matches, columns).agg(count("missing_data_rule").alias("datatype_matches_missing_rules"), count("fk_like_data_rule").alias("fk_like_data_rules"), F.count("*").alias("issues"))
    both = chosen.join(found)  # one row each
    return both.withColumn("datatype_matches_with_rules", F.col("selected_datatype_matches") - F.col("datatype_matches_missing_rules"))


def emission_issues(matches: DataFrame, rules: DataFrame, columns: DataFrame, counts: DataFrame, literals: DataFrame, summary: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, issue) of selected matches whose facts are missing, too many or no text, and of rules that don't do what they should.

    counts: iri, class_triples, predicate_triples. literals: iri, samples, identifier_like, of a predicate's literals that
    were looked at. summary: table_name, column_name, row_count, non_empty_count. stats: rule_id, reachable_rows,
    helper_calls, emitted, missing_rows (rows whose target or object row isn't there).
    """
    is_class = F.col("match_type") == "class"
    j = matches.filter("target IS NOT NULL").join(counts, F.col("target") == F.col("iri"), "left").drop("iri")
    j = j.join(literals.withColumnRenamed("iri", "_iri"), F.col("target") == F.col("_iri"), "left").join(summary, ["table_name", "column_name"], "left")
    n = F.coalesce(F.when(is_class, F.col("class_triples")).otherwise(F.col("predicate_triples")), F.lit(0))
    texts = reduce(lambda a, b: a | b, [F.contains(F.lower(F.concat_ws("_", "table_name", "column_name")), F.lit(w)) for w in TEXT_WORDS])
    texts = (F.col("match_type") == "datatype_property") & F.col("column_name").isNotNull() & texts
    rows = F.when(F.col("non_empty_count") > 0, F.col("non_empty_count")).otherwise(F.col("row_count"))
    found = _named(
        {
            "selected_target_zero_emission": n == 0,
            "text_like_selected_evidence_missing_literals": texts & (n == 0),
            "text_like_literal_identifier_like": texts & (n > 0) & (F.col("samples") > 0) & (F.col("identifier_like") >= 0.75 * F.col("samples")),
            "overbroad_emission": F.col("row_count").isNotNull() & (n > F.greatest(F.lit(20), 3 * rows)),
        }
    )
    of_matches = j.select(F.col("source_id").alias("id"), F.explode(found).alias("issue"))
    tables = _flag(columns.withColumnRenamed("table_name", "source_table"), ["source_table"], "_table")
    fks = columns.filter("is_fk").select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.lit(True).alias("_fk"))
    r = rules.join(tables, "source_table", "left").join(fks, ["source_table", "source_column"], "left").join(stats, "rule_id", "left")
    reach, calls, emitted, missing = (F.coalesce(c, F.lit(0)) for c in ("reachable_rows", "helper_calls", "emitted", "missing_rows"))
    found = _named(
        {
            "unknown_source_table": (F.col("source_table") != "") & ~_is("_table"),
            "fk_like_datatype_literal_without_justification": (F.col("kind") == "data") & _is("_fk") & (F.coalesce("subject_table", F.lit("")) == ""),
            "reachable_rule_zero_emission": (reach > 0) & (emitted == 0),
            "generated_code_path_zero_helper_calls": (reach > 0) & (calls == 0),
            "zero_row_join": (missing > 0) & (emitted == 0),
        }
    )
    of_rules = r.select(F.col("rule_id").alias("id"), F.explode(found).alias("issue"))
    read = rules.join(tables, "source_table").select("rule_id", "source_table", F.explode("columns").alias("source_column"))
    lost = read.join(columns.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column")), ["source_table", "source_column"], "left_anti")
    of_columns = lost.select(F.col("rule_id").alias("id"), F.lit("unknown_source_column").alias("issue"))
    return of_matches.unionByName(of_rules).unionByName(of_columns)


def emission_summary(issues: DataFrame, matches: DataFrame, generated: int | Column, invalid: int | Column) -> DataFrame:
    """One row of eleven counters."""
    count = lambda *names: F.count_if(F.col("issue").isin(*names))
    one = issues.agg(
        F.count("*").alias("issue_count"), count("selected_target_zero_emission").alias("zero_emission_selected_targets"), count("unknown_source_table", "unknown_source_column").alias("unknown_reference_issues"),
        count("fk_like_datatype_literal_without_justification").alias("fk_like_literal_issues"), count("overbroad_emission").alias("overbroad_issues"), count("reachable_rule_zero_emission").alias("zero_rule_issues"), count("generated_code_path_zero_helper_calls").alias("zero_branch_issues"),
    )
    chosen = matches.filter("target IS NOT NULL").agg(F.count("*").alias("selected_target_count"))
    out = chosen.join(one).withColumn("selected_targets_with_emission", F.col("selected_target_count") - F.col("zero_emission_selected_targets"))  # one row each
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return out.withColumn("invalid_triple_count", as_column(invalid).cast("long")).withColumn("generated_triples", as_column(generated).cast("long"))


def repairs(rules: DataFrame, actions: DataFrame, matches: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules after repair, rejected actions with reason) of proposed repairs of data rules.

    rules: position, source_table, source_column, target, match_ids. actions: action_id, action (repair, drop,
    add_data_rule, keep_with_justification), position of the rule or null, has_rule and the new rule's columns. A new
    rule must read a known column, and name a selected data match of that column and target. Of several good actions on
    one rule the last holds.
    """
    data = matches.filter(F.col("target").isNotNull() & F.col("source_id").startswith("source-data:")).select("source_id", "target", F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"))
    grounds = actions.select("action_id", "source_table", "source_column", "target", F.explode("match_ids").alias("source_id")).join(data, ["source_id", "source_table", "source_column", "target"], "left_semi")
    grounds = grounds.join(columns.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column")), ["source_table", "source_column"], "left_semi")
    there = rules.select(F.col("position").alias("_at")).distinct().withColumn("_there", F.lit(True))
    a = actions.join(_flag(grounds, ["action_id"], "_ground"), "action_id", "left").join(there, F.col("position") == F.col("_at"), "left")
    verb, ground = F.col("action"), _is("_ground")
    fits_drop, fits_repair, fits_add = (verb == "drop") & _is("_there"), (verb == "repair") & F.col("has_rule") & _is("_there"), (verb == "add_data_rule") & F.col("has_rule")
    reason = F.when(fits_repair & ~ground, "ungrounded_repaired_rule").when(fits_add & ~ground, "ungrounded_added_rule").when(fits_drop | fits_repair | fits_add | (verb == "keep_with_justification"), None).otherwise("unsupported_action_or_missing_rule")
    a = a.withColumn("reason", reason)
    rejected = a.filter("reason IS NOT NULL").select("action_id", "action", "reason")
    body = ["source_table", "source_column", "target", "match_ids"]
    good = a.filter("reason IS NULL")
    last = good.filter("action IN ('drop', 'repair')").groupBy("position").agg(F.max_by(F.struct("action", *body), "action_id").alias("_new"))
    kept = rules.join(last, "position", "left").filter(F.col("_new").isNull() | (F.col("_new.action") == "repair"))
    kept = kept.select("position", *[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in body])
    added = good.filter("action = 'add_data_rule'").select(F.lit(None).cast(rules.schema["position"].dataType).alias("position"), *body)
    return kept.unionByName(added), rejected


def round2(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """(kind, position, rule) after a list of actions: replaced rules, then the dropped ones left out, then added ones behind.

    rules: kind, position, rule; actions: number, action, kind, position, rule. The last replacement of a rule holds; a
    replacement without a position is added; positions that no rule has do nothing. Positions close up behind drops.
    """
    put = actions.filter("action = 'repair' AND rule IS NOT NULL AND position IS NOT NULL").groupBy("kind", "position").agg(F.max_by("rule", "number").alias("_new"))
    gone = actions.filter("action = 'drop' AND position IS NOT NULL").select("kind", "position").distinct()
    kept = rules.join(put, ["kind", "position"], "left").join(gone, ["kind", "position"], "left_anti").select("kind", F.lit(0).alias("_late"), F.col("position").cast("long").alias("_at"), F.coalesce("_new", "rule").alias("rule"))
    more = actions.filter("rule IS NOT NULL AND (action IN ('add_class_rule', 'add_data_rule') OR (action = 'repair' AND position IS NULL))")
    kind = F.when(F.col("action") == "add_class_rule", "class").when(F.col("action") == "add_data_rule", "data").otherwise(F.col("kind"))
    every = kept.unionByName(more.select(kind.alias("kind"), F.lit(1).alias("_late"), F.col("number").cast("long").alias("_at"), "rule"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("_late", "_at")) - 1  # a row a rule of the program
    return every.select("kind", place.cast("long").alias("position"), "rule")


def preservation(before: DataFrame, after: DataFrame, limit: float = 0.02) -> DataFrame:
    """(reason) why a changed set of rules may not replace the old one: too many targets lost, of a kind or in all, or URIs made of other columns.

    Both: kind, source_table, target, id_columns (text; of class rules).
    """
    found = before.sparkSession.createDataFrame([], "reason string")
    for kind in ("all", "class", "data", "object"):
        b, a = (x.filter(F.lit(kind == "all") | (F.col("kind") == kind)).select("target").distinct() for x in (before, after))
        one = b.join(a.withColumn("_a", F.lit(True)), "target", "left").agg(F.count_if(F.col("_a").isNull()).alias("lost"), F.count("*").alias("n"))
        found = found.unionByName(one.filter(F.col("lost") / F.greatest(F.lit(1), F.col("n")) > limit).select(F.lit(f"{kind}_target_coverage_drop_gt_{limit}").alias("reason")))
    return found.unionByName(template_changes(before, after).limit(1).select(F.lit("uri_template_changed_or_missing").alias("reason")))


def template_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_table, target, reason) of class rules whose URIs are gone or made of other columns. Of equal class rules the last counts."""
    classes = lambda x, n: x.filter("kind = 'class'").groupBy("source_table", "target").agg(F.max("id_columns").alias(n))
    j = classes(before, "_b").join(classes(after, "_a").withColumn("_there", F.lit(True)), ["source_table", "target"], "left")
    changed = (F.coalesce("_b", F.lit("")) != "") & (F.coalesce("_a", F.lit("")) != "") & (F.col("_a") != F.col("_b"))
    reason = F.when(F.col("_there").isNull(), "missing_in_new").when(changed, "id_columns_changed")
    return j.select("source_table", "target", reason.alias("reason")).filter("reason IS NOT NULL")


def safe_rules(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """(rule_id, reason) of rules that an overlay can't take, first reason that holds.

    rules: rule_id, kind, source_table, source_column, source_columns, target_columns, id_columns (arrays), target,
    target_table. columns: table_name, column_name, is_fk.
    """
    names = columns.groupBy("table_name").agg(F.collect_set("column_name").alias("_n"), F.collect_set(F.when(F.col("is_fk"), F.col("column_name"))).alias("_fk"))
    r = rules.join(names.withColumnRenamed("table_name", "source_table"), "source_table", "left")
    r = r.join(names.select(F.col("table_name").alias("target_table"), F.col("_n").alias("_tn")), "target_table", "left")
    unknown = lambda c, n: F.size(F.array_except(c, n)) > 0
    low = F.lower(F.regexp_extract("target", r"([^#/]*)$", 1))
    names_one = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("id", "identifier", "doi", "url", "email", "isbn", "issn", "code")])
    is_ = lambda k: F.col("kind") == k
    reason = (
        F.when(F.col("_n").isNull(), "unknown_source_table").when(is_("class") & unknown("id_columns", "_n"), "unknown_class_id_column").when(is_("data") & ~F.array_contains("_n", F.col("source_column")), "unknown_data_source_column")
        .when(is_("data") & F.array_contains("_fk", F.col("source_column")) & ~names_one, "fk_like_literal_without_identifier_target").when(is_("object") & F.col("_tn").isNull(), "unknown_object_target_table")
        .when(is_("object") & unknown("source_columns", "_n"), "unknown_object_source_column").when(is_("object") & unknown("target_columns", "_tn"), "unknown_object_target_column")
    )
    return r.select("rule_id", reason.alias("reason")).filter("reason IS NOT NULL")


def ordered_distinct(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row in order of each key."""
    return rows.groupBy(*key).agg(F.min(order).alias(order))


def run_counts(matches: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """by, no_match_rate (null without matches), invalid_rule_count: accepted matches that no rule came of, by numbers alone."""
    m = matches.groupBy(by).agg(F.avg(F.col("target").isNull().cast("double")).alias("no_match_rate"), F.count("target").alias("_accepted"))
    r = rules.groupBy(by).agg(F.count("*").alias("_rules"))
    return m.join(r, by, "left").select(by, "no_match_rate", F.greatest(F.lit(0), F.col("_accepted") - F.coalesce("_rules", F.lit(0))).alias("invalid_rule_count"))
