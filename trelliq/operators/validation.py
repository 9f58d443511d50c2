"""Checks of rules, matches, coverage and decisions; each issue is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


# Fixed values throughout: the names of issues.


def issues(df: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """A row for each test that holds: the key and the test's name."""
    found = F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])
    return df.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def target_provenance(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Rules whose target, or whose every match id, isn't among the selected matches; rules without match ids."""
    chosen = matches.filter("target is not null")
    bad_target = rules.join(chosen.select("target").distinct(), "target", "left_anti").select("rule_id", F.lit("target_not_in_selected_matches").alias("issue"))
    none = rules.filter(F.size("match_ids") == 0).select("rule_id", F.lit("missing_match_ids").alias("issue"))
    ids = rules.select("rule_id", F.explode("match_ids").alias("source_id"))
    known = ids.join(chosen.select("source_id").distinct(), "source_id", "left_semi").select("rule_id").distinct()
    lost = ids.select("rule_id").distinct().join(known, "rule_id", "left_anti").select("rule_id", F.lit("match_ids_do_not_reference_selected_matches").alias("issue"))
    return bad_target.unionByName(none).unionByName(lost)


def rule_issues(rules: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(rule_id, issue) of what the schema contradicts, for any number of rules and tables: joins on tables and columns.

    rules: rule_id, kind, source_table, source_column, filter_column, and as arrays source_columns, target_columns,
    subject_columns, object_columns, with target_table, subject_table, object_table (empty: none). A rule of an unknown
    table has that issue alone, an object rule with an unknown target table no further one. An issue of columns comes
    once for each of them.
    """
    from .lake import key_lists, with_keys

    c = with_keys(columns, keys)
    per = c.groupBy("table_name").agg(F.collect_set("column_name").alias("_names"), F.collect_set(F.when(F.col("is_fk"), F.col("column_name"))).alias("_fks"), F.sort_array(F.collect_list(F.when(F.col("is_pk"), F.col("column_name")))).alias("_pk"))
    r = rules.join(per.withColumnRenamed("table_name", "source_table"), "source_table", "left")
    for side in ("target", "subject", "object"):
        r = r.join(per.select(F.col("table_name").alias(f"{side}_table"), F.lit(True).alias(f"_{side}"), *([F.col("_pk").alias("_target_pk")] if side == "target" else [])), f"{side}_table", "left")
    lists = key_lists(keys).select(F.col("child").alias("source_table"), F.col("parent").alias("target_table"), F.arrays_zip(F.col("key").alias("a"), F.col("ref").alias("b")).alias("_key")).groupBy("source_table", "target_table").agg(F.collect_set("_key").alias("_keys"))
    r = r.join(lists, ["source_table", "target_table"], "left")
    known, is_data, is_object = F.col("_names").isNotNull(), F.col("kind") == "data", F.col("kind") == "object"
    sided = (F.col("subject_table") != "") | (F.col("object_table") != "")
    grounded_ = known & is_object & F.col("_target").isNotNull()
    own = F.sort_array(F.arrays_zip(F.col("source_columns").alias("a"), F.when(F.size("target_columns") > 0, F.col("target_columns")).otherwise(F.col("_target_pk")).alias("b")))
    tests = {
        "unknown_source_table": ~known,
        "invalid_row_filter": known & (F.col("kind") == "class") & F.col("filter_column").isNotNull() & ~F.array_contains("_names", F.col("filter_column")),
        "unknown_source_column": known & is_data & ~F.array_contains("_names", F.col("source_column")),
        "fk_column_used_as_direct_data_rule": known & is_data & (F.col("subject_table") == "") & F.array_contains("_fks", F.col("source_column")),
        "unknown_target_table": known & is_object & F.col("_target").isNull(),
        "unknown_subject_table": grounded_ & (F.col("subject_table") != "") & F.col("_subject").isNull(),
        "unknown_object_table": grounded_ & (F.col("object_table") != "") & F.col("_object").isNull(),
        "object_rule_not_supported_by_fk": grounded_ & ~sided & ~F.coalesce(F.array_contains("_keys", own), F.lit(False)),
    }
    out = issues(r, ["rule_id"], tests)
    for side in ("subject", "object"):
        lost = F.array_except(F.col(f"{side}_columns"), F.col("_names"))
        out = out.unionByName(r.filter(grounded_ & sided).select("rule_id", F.explode(lost).alias("c")).select("rule_id", F.lit(f"unknown_{side}_columns").alias("issue")))
    return out


def missing_discriminators(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Discriminator matches (source_id, target, filter_column) that no class rule has."""
    have = rules.filter("kind = 'class' AND filter_column IS NOT NULL").select("target", "filter_column").distinct()
    return matches.join(have, ["target", "filter_column"], "left_anti").select("source_id", F.lit("missing_discriminator_class_rule").alias("issue"))


def grounded(rules: DataFrame, columns: DataFrame, targets: DataFrame) -> DataFrame:
    """Rules with a known table, a known column (where one is named) and a known target; an internal id stands for its one URI of the kind."""
    uri = targets.groupBy("kind", "id").agg(F.count_distinct("uri").alias("n"), F.min("uri").alias("uri")).filter("n = 1")
    r = rules.join(uri.select("kind", F.col("id").alias("target"), "uri"), ["kind", "target"], "left").withColumn("target", F.coalesce("uri", "target")).drop("uri")
    known = r.join(targets.select("kind", F.col("uri").alias("target")).distinct(), ["kind", "target"], "left_semi")
    tables = columns.select(F.col("table_name").alias("source_table")).distinct()
    named = columns.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.lit(True).alias("_c"))
    return known.join(tables, "source_table", "left_semi").join(named, ["source_table", "source_column"], "left").filter((F.col("source_column") == "") | F.col("_c")).drop("_c")


# Roles that may stand before a target, words of targets that are identifiers.
ROLE_PREFIXES = ("class", "data_property", "datatype_property", "object_property")
IDENTIFIER_WORDS = ("id", "identifier", "paperid", "paper_id", "doi", "url", "email", "isbn", "issn", "code")


def strip_role_prefix(uri: Column) -> Column:
    """A target without the role before it, where a URI is left."""
    return F.regexp_replace(uri, f"^({'|'.join(ROLE_PREFIXES)}):(?=http://|https://|urn:)", "")


def identifier_target(target: Column) -> Column:
    """A target one of whose words, or whose text without ``-`` and ``_``, holds an identifier word."""
    squeezed = F.regexp_replace(F.lower(target), "[-_]", "")
    inside = [F.contains(squeezed, F.lit(w.replace("_", ""))) for w in IDENTIFIER_WORDS]
    return F.arrays_overlap(text.word_set(target), F.array(*map(F.lit, IDENTIFIER_WORDS))) | reduce(lambda a, b: a | b, inside)


def side_score(words: Column, listed: Column, empty: int) -> Column:
    """Best fit of a class's words to listed names: 2 same, 1 shared, 0 none; ``empty`` where none are listed."""
    one = F.transform(listed, lambda n: _fit(words, text.word_set(text.local_name(n))))
    return F.when(F.size(listed) == 0, empty).otherwise(F.coalesce(F.array_max(one), F.lit(0)))


def _fit(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((both == F.size(a)) & (both == F.size(b)), 2).when(both > 0, 1).otherwise(0)


def evidence_score(listed: Column, classes: Column) -> Column:
    """Best fit of any class to any listed name; 1 if either side has none."""
    each = F.transform(classes, lambda c: side_score(text.word_set(text.local_name(c)), listed, 1))
    return F.when((F.size(listed) == 0) | (F.size(classes) == 0), 1).otherwise(F.array_max(each))


def match_issues(matches: DataFrame, columns: DataFrame) -> DataFrame:
    """Kind mismatches, keys matched to properties that aren't identifiers, or to identifiers of something else.

    matches: source_id, source_kind, target, target_kind, domain (text of the target's domains).
    """
    parts = matches.withColumn("table_name", F.regexp_extract("source_id", r"^source-data:([^.]+)\.", 1)).withColumn("column_name", F.regexp_extract("source_id", r"^source-data:[^.]+\.(.+)$", 1))
    m = parts.join(columns.select("table_name", "column_name", "is_fk", "column_role"), ["table_name", "column_name"], "left")
    like = identifier_target(F.col("target"))
    data = F.col("target_kind") == "data_property"
    fk, low = F.coalesce("is_fk", F.lit(False)), F.lower("column_name")
    generic = fk | (low == "id") | ((F.col("column_role") == "primary_key") & low.endswith("_id"))
    here = F.contains(F.lower(F.coalesce("domain", F.lit(""))), F.lower("table_name")) | low.isin("paper", "paperid", "paper_id")
    tests = {
        "fk_column_mapped_to_non_identifier_data_property": fk & data & ~like,
        "fk_column_mapped_to_context_mismatched_identifier_property": fk & data & like & ~here,
        "generic_identifier_mapped_to_non_identifier_data_property": F.coalesce(generic, F.lit(False)) & data & ~like,
    }
    chosen = m.filter("target is not null")
    kinds = chosen.filter("source_kind <> '' AND target_kind <> '' AND source_kind <> target_kind").select("source_id", F.concat(F.lit("kind_mismatch:"), "source_kind", F.lit("->"), "target_kind").alias("issue"))
    return kinds.unionByName(issues(chosen, ["source_id"], tests))


def direct_reachability(child: DataFrame, columns: list[str], parent: DataFrame, ref: list[str]) -> DataFrame:
    """One row: rows with a full key, and rows whose key exists among the parent's ``ref`` columns."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns])
    keys = parent.select(*[F.col(r).cast("string").alias(f"_k{i}") for i, r in enumerate(ref)]).distinct().withColumn("_hit", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(c).cast("string") == F.col(f"_k{i}") for i, c in enumerate(columns)])
    return child.join(keys, on, "left").agg(F.count("*").alias("row_count"), F.count_if(full).alias("nonempty_rows"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("hit_rows"))


def association_reachability(rows: DataFrame, left: tuple[str, DataFrame, str], right: tuple[str, DataFrame, str]) -> DataFrame:
    """One row: full keys, hits on either side and on both, of an association between two tables."""
    out = rows
    for tag, (column, parent, ref) in (("a", left), ("b", right)):
        keys = parent.select(F.col(ref).cast("string").alias(f"_{tag}")).distinct().withColumn(f"_hit_{tag}", F.lit(True))
        out = out.join(keys, F.col(column).cast("string") == F.col(f"_{tag}"), "left")
    a, b = (F.coalesce(f"_hit_{t}", F.lit(False)) for t in "ab")
    full = F.col(left[0]).isNotNull() & F.col(right[0]).isNotNull()
    return out.agg(F.count_if(full).alias("nonempty_rows"), F.count_if(a).alias("subject_hits"), F.count_if(b).alias("object_hits"), F.count_if(a & b).alias("both_hits"))


def object_plans(matches: DataFrame, keys: DataFrame, classes: DataFrame, roles: DataFrame) -> DataFrame:
    """Legal ways to emit an object match, where domain and range allow the classes of the tables at the ends.

    matches: source_id, child, columns, domain, range (arrays); keys: child, key, parent, ref; classes: table_name,
    target; roles: table_name, role. The matched key itself gives a direct and an inverse way; in a table that is a join
    table or has another key, each other key gives two ways through the table: with the matched key's table as the
    subject, and as the object. plan_id is the source, the orientation and the fields as sorted JSON.
    """
    c = classes.groupBy("table_name").agg(F.collect_set("target").alias("t"))
    k = keys.select("child", F.col("key").alias("columns"), "parent", "ref")
    m = matches.withColumn("columns", F.sort_array("columns")).join(k, ["child", "columns"])
    none = F.lit(None).cast("array<string>")
    way = lambda o, label, a, ak, ar, b, bk, br: F.struct(F.lit(o).alias("orientation"), F.lit(label).alias("confidence_label"), a.alias("subject_table"), ak.alias("subject_columns"), ar.alias("subject_target_columns"), b.alias("object_table"), bk.alias("object_columns"), br.alias("object_target_columns"))
    col = F.col
    one = m.select("*", F.explode(F.array(way("direct_fk", "direct_fk", col("child"), none, none, col("parent"), col("columns"), col("ref")), way("inverse_fk", "reverse_fk", col("parent"), col("columns"), col("ref"), col("child"), none, none))).alias("w"))
    others = k.select("child", F.col("columns").alias("_k"), F.col("parent").alias("_p"), F.col("ref").alias("_r"))
    bridges = m.join(others, "child").filter(F.col("_k") != F.col("columns")).join(roles.select(F.col("table_name").alias("child")), "child", "left_semi")
    two = bridges.select(*m.columns, F.explode(F.array(way("join_subject_matched_fk", "join_table", col("parent"), col("columns"), col("ref"), col("_p"), col("_k"), col("_r")), way("join_object_matched_fk", "join_table", col("_p"), col("_k"), col("_r"), col("parent"), col("columns"), col("ref")))).alias("w"))
    p = one.unionByName(two).select("source_id", F.col("child").alias("source_table"), "domain", "range", "w.*")
    for side in ("subject", "object"):
        p = p.join(c.select(F.col("table_name").alias(f"{side}_table"), F.col("t").alias(f"{side}_classes")), f"{side}_table", "left").withColumn(f"{side}_classes", F.coalesce(f"{side}_classes", F.array().cast("array<string>")))
    p = p.filter((evidence_score(F.col("domain"), F.col("subject_classes")) > 0) & (evidence_score(F.col("range"), F.col("object_classes")) > 0)).drop("domain", "range")
    fields = F.to_json(F.struct("object_columns", "object_table", "source_table", "subject_columns", "subject_table"))
    return p.withColumn("plan_id", F.concat_ws("|", "source_id", F.when(F.col("orientation") == "direct_fk", "direct").when(F.col("orientation") == "inverse_fk", "inverse").otherwise(F.col("orientation")), fields))


#: Fields in which a rule must agree with its plan.
PLAN_FIELDS = ("source_table", "subject_table", "subject_columns", "subject_target_columns", "object_table", "object_columns", "object_target_columns")


def plan_conformance(rules: DataFrame, plans: DataFrame) -> DataFrame:
    """(rule_id, issue, field) of object rules without a plan or with an unknown one, of each field that differs from the plan's,
    and of plans that reach no fact though their table has rows (source_rows, estimated_emissions)."""
    held = plans.select(F.col("plan_id").alias("_id"), "source_rows", "estimated_emissions", *[F.col(f).alias(f"_{f}") for f in PLAN_FIELDS]).dropDuplicates(["_id"])
    j = rules.drop("source_rows", "estimated_emissions").join(held, F.col("plan_id") == F.col("_id"), "left")
    there = F.col("_id").isNotNull()
    row = lambda issue, field, test: F.when(test, F.struct(F.lit(issue).alias("issue"), F.lit(field).alias("field")))
    found = [row("missing_object_plan_id", "", F.coalesce("plan_id", F.lit("")) == ""), row("unknown_object_plan_id", "", (F.coalesce("plan_id", F.lit("")) != "") & ~there)]
    found += [row("object_rule_does_not_match_plan", f, there & ~F.col(f).eqNullSafe(F.col(f"_{f}"))) for f in PLAN_FIELDS]
    found.append(row("object_plan_zero_reachability", "", there & (F.col("source_rows") > 0) & (F.col("estimated_emissions") == 0)))
    return j.select("rule_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("rule_id", "x.*")


def mapping_diagnostics(matches: DataFrame, rules: DataFrame, column_roles: DataFrame, table_roles: DataFrame) -> DataFrame:
    """One row of eight counters of selected matches and rules."""
    m = matches.filter("target IS NOT NULL")
    ids = column_roles.filter("generic_identifier").select(F.concat(F.lit("source-data:"), "table_name", F.lit("."), "column_name").alias("source_id"), F.lit(1).alias("_g")).distinct()
    joins = table_roles.filter("role = 'join_table'").select(F.concat(F.lit("source-class:"), "table_name").alias("source_id"), F.lit(1).alias("_j"))
    one = m.join(ids, "source_id", "left").join(joins, "source_id", "left").agg(
        F.count("*").alias("selected_matches"), F.count_if(~F.col("target").rlike("^(https?://|urn:)")).alias("invalid_target_uri_count"), F.count_if(F.col("target").startswith("n")).alias("anonymous_target_count"),
        F.count("_g").alias("generic_id_data_matches"), F.count("_j").alias("join_table_class_matches"),
    )
    return one.join(rules.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_rules") for k in ("class", "data", "object")]))  # one row each


def usage_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, before, after: how many rules read what, where that changed."""
    count = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
    both = count(before, "before").join(count(after, "after"), key, "full_outer").select(*key, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("before", "after")])
    return both.filter("before <> after")


#: Matches, and rules, of one target that meet in one task at once, about.
BLOCK = 4000


def rules_for_matches(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_id, rule_id): same target, or the rule names the match; each pair once.

    The pairs of a target grow with the square of its ids, so they are made by the last step, neither moved nor compared:
    an id is one row with all its targets, a target's matches and rules are dealt to blocks, and each block of matches
    meets the list of each block of rules in a task. Ids that share several targets meet at the smallest one; a rule
    that names a match meets it only if they share none.
    """
    m = matches.groupBy("source_id").agg(F.collect_set("target").alias("mt"))
    r = rules.groupBy("rule_id").agg(F.collect_set("target").alias("rt"), F.array_distinct(F.flatten(F.collect_list("match_ids"))).alias("match_ids"))
    # the other targets are kept only where there are any
    ms = m.select("source_id", F.when(F.size("mt") > 1, F.col("mt")).alias("mt"), F.explode("mt").alias("target"))
    rs = r.select("rule_id", F.when(F.size("rt") > 1, F.col("rt")).alias("rt"), F.explode("rt").alias("target"))
    blocks = lambda rows, name: rows.groupBy("target").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    both = blocks(ms, "m_n").join(blocks(rs, "r_n"), "target")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = ms.join(both, "target").select("target", "source_id", "mt", F.pmod(F.xxhash64("source_id"), "m_n").alias("m_no"), every("r_n").alias("r_no"))
    lists = rs.join(both, "target").groupBy("target", "m_n", F.pmod(F.xxhash64("rule_id"), "r_n").alias("r_no")).agg(F.collect_list(F.struct("rule_id", "rt")).alias("r"))
    lists = lists.select("target", "r_no", "r", every("m_n").alias("m_no"))
    on = ["target", "m_no", "r_no"]
    tasks = 8 * matches.sparkSession.sparkContext.defaultParallelism  # by number: bytes don't tell how many pairs come out
    met = asking.repartition(tasks, *on).join(lists.repartition(tasks, *on), on).select("target", "source_id", "mt", F.explode("r").alias("r"))
    once = F.col("mt").isNull() | F.col("r.rt").isNull() | (F.col("target") == F.array_min(F.array_intersect("mt", "r.rt")))
    by_target = met.filter(once).select("source_id", "r.rule_id")
    named = r.select("rule_id", "rt", F.explode("match_ids").alias("source_id")).join(m, "source_id")
    by_id = named.filter(~F.arrays_overlap("mt", "rt")).select("source_id", "rule_id")
    return by_target.unionByName(by_id)


def vector_issues(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    from ..functions.vectors import vector_issue

    return rows.select(key, vector_issue(F.col(vector), size).alias("issue")).filter("issue is not null")


def contract_issues(responses: DataFrame, allowed: DataFrame) -> DataFrame:
    """JSON answers that break the contract: unreadable, not one decision, another source, a URI not offered, a confidence outside 0 to 1.

    responses: source_id, body; allowed: source_id, target.
    """
    parsed = F.from_json("body", "matches array<struct<source_id:string,target_uri:string,confidence:double>>")
    r = responses.withColumn("m", parsed["matches"]).withColumn("one", F.try_element_at("m", F.lit(1)))
    offered = allowed.groupBy("source_id").agg(F.collect_set("target").alias("offered"))
    r = r.join(offered, "source_id", "left")
    target, confidence = F.col("one.target_uri"), F.col("one.confidence")
    tests = {
        "invalid_json": F.col("m").isNull(),
        "not_one_decision": F.size("m") != 1,
        "source_id_mismatch": F.col("one.source_id") != F.col("source_id"),
        "target_not_offered": target.isNotNull() & ~F.coalesce(F.array_contains("offered", target), F.lit(False)),
        "confidence_out_of_range": F.col("one").isNotNull() & (confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1)),
    }
    return issues(r, ["source_id"], tests)


def shortlist_issues(rows: DataFrame, most: int = 3, reasons: int = 3) -> DataFrame:
    """Shortlists (source_id, items array<struct<target, reasons>>) that are empty, too long, repeated or without their reasons."""
    tests = {
        "empty_shortlist": F.size("items") == 0,
        "too_many_items": F.size("items") > most,
        "repeated_item": F.size(F.array_distinct(F.transform("items", lambda x: x["target"]))) < F.size("items"),
        "wrong_reason_count": F.exists("items", lambda x: F.size(x["reasons"]) != reasons),
    }
    return issues(rows, ["source_id"], tests)


def merge_rules(parts: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rules of several parts, equal ones once: the first in order stays."""
    body = F.to_json(F.struct(*key))
    return parts.groupBy(body.alias("rule")).agg(F.min(order).alias("position"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows dropped and added, each with its side."""
    return before.exceptAll(after).withColumn("change", F.lit("dropped")).unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))


def coverage_diff(before: DataFrame, after: DataFrame, column: str = "target") -> DataFrame:
    """One row: targets before, after, dropped and added, and the share dropped."""
    b, a = before.select(column).distinct(), after.select(column).distinct()
    j = b.withColumn("_b", F.lit(True)).join(a.withColumn("_a", F.lit(True)), column, "full_outer")
    out = j.agg(F.count("_b").alias("before"), F.count("_a").alias("after"), F.count_if(F.col("_a").isNull()).alias("dropped"), F.count_if(F.col("_b").isNull()).alias("added"))
    return out.withColumn("drop_ratio", F.coalesce(F.try_divide("dropped", "before"), F.lit(0.0)))


def preservation_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether a change keeps all selected targets, filtered classes and object groundings, and what it loses."""
    def lost(kind: str, key: list[str], test: Column) -> DataFrame:
        return before.filter(test).select(*key).distinct().join(after.filter(test).select(*key).distinct(), key, "left_anti").agg(F.count("*").alias(kind))

    one = lost("lost_targets", ["target"], F.lit(True)).join(lost("lost_filters", ["target", "filter_column"], F.col("filter_column").isNotNull())).join(lost("lost_objects", ["target", "source_table", "target_table"], F.col("kind") == "object"))
    return one.withColumn("accepted", (F.col("lost_targets") + F.col("lost_filters") + F.col("lost_objects")) == 0)


def overlay(before: DataFrame, after: DataFrame, limit: float = 0.02) -> DataFrame:
    """The changed rules, and where more than ``limit`` of the old targets would go, the old rules of those targets as well."""
    ratio = coverage_diff(before, after).select("drop_ratio")
    kept = before.join(after.select("target").distinct(), "target", "left_anti").crossJoin(F.broadcast(ratio)).filter(F.col("drop_ratio") > limit).drop("drop_ratio")  # one row
    return after.unionByName(kept)
