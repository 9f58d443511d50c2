"""prof_* and val_* over the lake of schemas: roles, graphs, patterns, rules, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import coverage, lake, requests
from ..operators import validation as ops
from .base import register
from .corpus import COLUMNS, KEYS, ask, columns, duck, keys, listed, matches, rules
from .retrieving import words_sql

REGISTRY: dict = {}


def fk_columns(spark, d):
    return lake.with_keys(columns(spark, d), keys(spark, d))


# --- schemas ---------------------------------------------------------------------------------------------------------

_ROLE = (
    "SELECT p.table_name, CASE WHEN p > 1 AND p = n THEN 'join_table' WHEN p > 0 AND b = p THEN 'subtype_table' WHEN coalesce(q, 0) > 1 AND rest = 0 AND n <= f + 1 THEN 'join_table' ELSE 'entity_table' END AS role, coalesce(q, 0) > 0 AND f = n AS join_like FROM "
    "(SELECT table_name, count(*) AS n, count(*) FILTER (is_pk) AS p, count(*) FILTER (is_fk) AS f, count(*) FILTER (is_pk AND is_fk) AS b, count(*) FILTER (NOT is_pk AND NOT is_fk) AS rest FROM w GROUP BY 1) p LEFT JOIN (SELECT child, count(DISTINCT key_id) AS q FROM k GROUP BY 1) z ON child = p.table_name"
)


@register(REGISTRY, "prof_table_roles", duck(_ROLE))
def _(spark, d):
    return lake.table_roles(columns(spark, d), keys(spark, d))


_DISC = "(starts_with(lower(column_name), 'is_') OR lower(column_name) = 'type' OR datatype = 'boolean')"


@register(REGISTRY, "prof_column_roles", duck(f"SELECT table_name, column_name, CASE WHEN is_pk THEN 'primary_key' WHEN is_fk THEN 'foreign_key' WHEN column_name = 'id' THEN 'generic_identifier' ELSE 'attribute' END AS column_role, {_DISC} AS discriminator, is_fk OR column_name = 'id' OR (is_pk AND column_name LIKE '%\\_id' ESCAPE '\\') AS generic_identifier FROM w"))
def _(spark, d):
    return lake.column_roles(columns(spark, d), keys(spark, d))


_LISTS = "SELECT child, key_id, parent, list(column_name ORDER BY column_name) AS cols, list(ref_column ORDER BY column_name) AS refs FROM k GROUP BY ALL"
_PK = "SELECT table_name, list(column_name ORDER BY column_name) FILTER (is_pk) AS pk, min_by(column_name, position) AS first FROM c GROUP BY 1"
_PARENT = "SELECT child, min_by(parent, key_id) AS parent, min(key_id) AS key_id FROM lists JOIN pks ON child = table_name AND cols = pk GROUP BY child"
_MORE = {"lists": _LISTS, "pks": _PK, "parents": _PARENT, "roles": _ROLE}


@register(
    REGISTRY,
    "prof_schema_graph",
    duck(
        "SELECT 'contains_column' AS kind, table_name AS source, table_name || '.' || column_name AS target FROM c UNION ALL SELECT 'primary_key', table_name, table_name || '.' || column_name FROM c WHERE is_pk UNION ALL "
        "SELECT 'foreign_key', child || '.' || column_name, parent || '.' || ref_column FROM k UNION ALL SELECT 'reverse_foreign_key', parent, child FROM lists UNION ALL SELECT 'primary_key_as_foreign_key', child, parent FROM parents",
        **_MORE,
    ),
)
def _(spark, d):
    return lake.edges(columns(spark, d), keys(spark, d))


@register(
    REGISTRY,
    "prof_components",
    f"WITH RECURSIVE c AS ({COLUMNS}), k AS ({KEYS}), t AS (SELECT DISTINCT table_name FROM c), e AS (SELECT child AS a, parent AS b FROM k WHERE parent IN (SELECT table_name FROM t) UNION SELECT parent, child FROM k WHERE parent IN (SELECT table_name FROM t)), "
    "reach AS (SELECT table_name AS a, table_name AS b FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT min(b) AS component, a AS table_name FROM reach GROUP BY a",
)
def _(spark, d):
    return lake.components(columns(spark, d), keys(spark, d))


@register(REGISTRY, "prof_fk_neighbors", duck("SELECT table_name FROM c WHERE t % 9 = 0 UNION SELECT parent FROM k JOIN c ON child = c.table_name WHERE t % 9 = 0"))
def _(spark, d):
    some = columns(spark, d).filter("t % 9 = 0").select("table_name").distinct()
    return lake.neighbours(some, keys(spark, d))


_PATTERNS = (
    "SELECT *, CASE pattern_type " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in lake.SCORES.items()) + " END::DOUBLE AS score FROM (SELECT CASE WHEN role = 'join_table' THEN 'JOIN_TABLE_OBJECT' WHEN s.child IS NOT NULL THEN 'SUBCLASS_PKFK' WHEN q > 1 THEN 'ASSOCIATION_ENTITY' ELSE 'SCHEMA_ENTITY' END AS pattern_type, roles.table_name, "
    "CASE WHEN role = 'join_table' OR (s.child IS NULL AND q > 1) THEN array_to_string(f, ',') ELSE coalesce(array_to_string(pk, ','), first) END AS columns FROM roles JOIN pks USING (table_name) LEFT JOIN parents s ON s.child = roles.table_name LEFT JOIN (SELECT child, count(*) AS q FROM lists GROUP BY 1) n ON n.child = roles.table_name LEFT JOIN (SELECT child, list_sort(list(DISTINCT column_name)) AS f FROM k GROUP BY 1) g ON g.child = roles.table_name "
    "UNION ALL SELECT 'IDENTIFIER_AS_URI', roles.table_name, array_to_string(pk, ',') FROM roles JOIN pks USING (table_name) WHERE pk IS NOT NULL AND role <> 'join_table' AND roles.table_name NOT IN (SELECT child FROM parents) "
    "UNION ALL SELECT 'FK_OBJECT', l.child, array_to_string(cols, ',') FROM lists l JOIN roles ON l.child = table_name AND role <> 'join_table' LEFT JOIN parents s ON s.child = l.child AND s.key_id = l.key_id WHERE s.child IS NULL "
    f"UNION ALL SELECT 'LITERAL_ATTRIBUTE', w.table_name, column_name FROM w JOIN roles ON roles.table_name = w.table_name AND role <> 'join_table' WHERE NOT is_pk AND NOT is_fk AND NOT {_DISC})"
)


@register(REGISTRY, "prof_patterns", duck(_PATTERNS, **_MORE))
def _(spark, d):
    return lake.patterns(columns(spark, d), keys(spark, d))


@register(REGISTRY, "prof_pattern_counts", duck(f"SELECT pattern_type, count(*) AS n, count(DISTINCT table_name) AS tables FROM ({_PATTERNS}) GROUP BY 1", **_MORE))
def _(spark, d):
    return lake.patterns(columns(spark, d), keys(spark, d)).groupBy("pattern_type").agg(F.count("*").alias("n"), F.count_distinct("table_name").alias("tables"))


@register(REGISTRY, "prof_pattern_rank", duck(f"SELECT table_name, pattern_type, columns, place FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, pattern_type, columns) AS place FROM ({_PATTERNS})) WHERE place <= 2", **_MORE))
def _(spark, d):
    return lake.best_patterns(lake.patterns(columns(spark, d), keys(spark, d)), 2).select("table_name", "pattern_type", "columns", F.col("place").cast("long"))


# --- patterns to rules -----------------------------------------------------------------------------------------------

_SELECTED = (
    "SELECT 'p' || CAST(t * 10 + position AS STRING) AS pattern_id, t * 10 + position AS position, CASE WHEN position = 1 THEN 'SCHEMA_ENTITY' WHEN x % 23 = 0 THEN 'ODD' WHEN x % 19 = 0 THEN 'IDENTIFIER_AS_URI' WHEN y % 2 = 0 THEN 'LITERAL_ATTRIBUTE' ELSE 'FK_OBJECT' END AS pattern_type, "
    "CASE WHEN x % 13 = 0 THEN NULL ELSE 'http://lake/q' || CAST(x % 60 AS STRING) END AS target, 0.7 AS score, x % 2 = 0 AS target_id_like, CASE WHEN y % 17 = 0 THEN 'ghost' ELSE table_name END AS source_table, CASE WHEN y % 14 = 0 THEN 'nope' ELSE column_name END AS source_column, "
    "CASE WHEN x % 12 = 0 THEN column_name || ',lost' ELSE column_name END AS source_columns, CASE WHEN x % 11 = 0 THEN 'ghost' ELSE 't' || CAST((t - t % 8) AS STRING) END AS target_table, CASE WHEN x % 15 = 0 THEN 'gone' ELSE '' END AS id_columns, CAST(NULL AS STRING) AS subject_table, CAST(NULL AS STRING) AS object_table"
    f" FROM ({COLUMNS}) c"
)
_TEMPLATES = f"SELECT table_name, column_name AS id_columns FROM ({COLUMNS}) c WHERE position = 1 AND t % 3 = 0"
_REASONED = (
    "SELECT s.*, coalesce(tp.id_columns, nullif(s.id_columns, ''), array_to_string(pk, ','), first) AS ids, CASE WHEN target IS NULL THEN 'target_not_selected' WHEN pks.table_name IS NULL THEN 'unknown_source_table' "
    "WHEN pattern_type = 'SCHEMA_ENTITY' AND tp.id_columns IS NULL AND s.id_columns = 'gone' THEN 'unknown_id_column' "
    "WHEN pattern_type = 'LITERAL_ATTRIBUTE' AND source_column = 'nope' THEN 'unknown_source_column' WHEN pattern_type = 'LITERAL_ATTRIBUTE' AND NOT target_id_like AND EXISTS (SELECT 1 FROM k WHERE child = source_table AND k.column_name = source_column) THEN 'fk_like_literal_rejected' "
    "WHEN pattern_type = 'FK_OBJECT' AND target_table NOT IN (SELECT table_name FROM c) THEN 'unknown_target_table' WHEN pattern_type = 'FK_OBJECT' AND source_columns LIKE '%,lost' THEN 'unknown_source_columns' WHEN pattern_type = 'ODD' THEN 'unsupported_pattern_type' END AS reason "
    "FROM sel s LEFT JOIN pks ON pks.table_name = source_table LEFT JOIN tp ON tp.table_name = source_table WHERE pattern_type <> 'IDENTIFIER_AS_URI'"
)
_COMPILING = _MORE | {"sel": _SELECTED, "tp": _TEMPLATES, "reasoned": _REASONED}


def compiled(spark, d, complete):
    picked = listed(ask(spark, d, _SELECTED), "source_columns", "id_columns")
    return lake.compile_patterns(picked, columns(spark, d), keys(spark, d), listed(ask(spark, d, _TEMPLATES), "id_columns"), complete)


_GOOD = "SELECT CASE pattern_type WHEN 'SCHEMA_ENTITY' THEN 'class' WHEN 'LITERAL_ATTRIBUTE' THEN 'data' ELSE 'object' END AS kind, source_table, target, CASE pattern_type WHEN 'SCHEMA_ENTITY' THEN ids WHEN 'LITERAL_ATTRIBUTE' THEN source_column ELSE source_columns END AS columns, CASE WHEN pattern_type = 'FK_OBJECT' THEN target_table END AS target_table, pattern_id, position FROM reasoned WHERE reason IS NULL"


@register(REGISTRY, "val_pattern_compile", duck(f"SELECT kind, source_table, target, columns, target_table, pattern_id FROM ({_GOOD})", **_COMPILING))
def _(spark, d):
    return compiled(spark, d, False)[0].select("kind", "source_table", "target", "columns", "target_table", "pattern_id")


@register(REGISTRY, "val_pattern_rejections", duck("SELECT pattern_id, reason FROM reasoned WHERE reason IS NOT NULL", **_COMPILING))
def _(spark, d):
    return compiled(spark, d, False)[1]


@register(
    REGISTRY,
    "val_type_completion",
    duck("SELECT DISTINCT e.t AS source_table, g.target, tp.id_columns AS columns FROM (SELECT source_table AS t, position FROM good WHERE kind = 'object' UNION ALL SELECT target_table, position FROM good WHERE kind = 'object') e JOIN tp ON tp.table_name = e.t JOIN good g ON g.kind = 'class' AND g.source_table = e.t AND g.position < e.position", **_COMPILING, good=_GOOD),
)
def _(spark, d):
    return compiled(spark, d, True)[0].filter("inferred_from IS NOT NULL").select("source_table", "target", "columns")


# --- rules against schemas and matches ---------------------------------------------------------------------------------

_KNOWN = "EXISTS (SELECT 1 FROM c WHERE c.table_name = {})"
_HAS = "EXISTS (SELECT 1 FROM c WHERE c.table_name = r.source_table AND c.column_name = {})"
_ISSUES = " UNION ALL ".join(
    f"SELECT rule_id, '{name}' AS issue FROM r WHERE {test}"
    for name, test in [
        ("unknown_source_table", "source_table = 'ghost'"),
        ("invalid_row_filter", f"source_table <> 'ghost' AND filter_column IS NOT NULL AND NOT {_HAS.format('r.filter_column')}"),
        ("unknown_source_column", "source_table <> 'ghost' AND kind = 'data' AND source_column = 'nope'"),
        ("fk_column_used_as_direct_data_rule", "source_table <> 'ghost' AND kind = 'data' AND subject_table = '' AND EXISTS (SELECT 1 FROM k WHERE child = source_table AND k.column_name = source_column)"),
        ("unknown_target_table", f"source_table <> 'ghost' AND kind = 'object' AND NOT {_KNOWN.format('r.target_table')}"),
        ("unknown_subject_table", f"source_table <> 'ghost' AND kind = 'object' AND {_KNOWN.format('r.target_table')} AND subject_table <> '' AND NOT {_KNOWN.format('r.subject_table')}"),
        ("unknown_object_table", f"source_table <> 'ghost' AND kind = 'object' AND {_KNOWN.format('r.target_table')} AND object_table <> '' AND NOT {_KNOWN.format('r.object_table')}"),
        ("unknown_subject_columns", f"source_table <> 'ghost' AND kind = 'object' AND {_KNOWN.format('r.target_table')} AND subject_columns <> '' AND NOT {_HAS.format('r.subject_columns')}"),
        ("unknown_object_columns", f"source_table <> 'ghost' AND kind = 'object' AND {_KNOWN.format('r.target_table')} AND object_columns <> '' AND NOT {_HAS.format('r.object_columns')}"),
        ("object_rule_not_supported_by_fk", f"source_table <> 'ghost' AND kind = 'object' AND {_KNOWN.format('r.target_table')} AND subject_table = '' AND object_table = '' AND NOT EXISTS (SELECT 1 FROM lists l WHERE l.child = source_table AND l.parent = target_table AND l.cols = [r.source_columns] AND l.refs = [r.target_columns])"),
    ]
)


@register(REGISTRY, "val_fol_issues", duck(_ISSUES, **_MORE))
def _(spark, d):
    return ops.rule_issues(rules(spark, d), columns(spark, d), keys(spark, d))


_PROVENANCE = (
    "SELECT rule_id, 'target_not_in_selected_matches' AS issue FROM r WHERE target NOT IN (SELECT target FROM m WHERE target IS NOT NULL) UNION ALL SELECT rule_id, 'missing_match_ids' FROM r WHERE match_ids = '' "
    "UNION ALL SELECT rule_id, 'match_ids_do_not_reference_selected_matches' FROM r WHERE match_ids <> '' AND match_ids NOT IN (SELECT source_id FROM m WHERE target IS NOT NULL)"
)


@register(REGISTRY, "val_target_provenance", duck(_PROVENANCE))
def _(spark, d):
    return ops.target_provenance(rules(spark, d), matches(spark, d))


@register(REGISTRY, "val_issue_counts", duck(f"SELECT issue, count(*) AS n FROM ({_PROVENANCE} UNION ALL {_ISSUES}) GROUP BY issue", **_MORE))
def _(spark, d):
    r = rules(spark, d)
    both = ops.target_provenance(r, matches(spark, d)).unionByName(ops.rule_issues(r, columns(spark, d), keys(spark, d)))
    return both.groupBy("issue").agg(F.count("*").alias("n"))


_FILTERS = f"SELECT 'source-discriminator:' || table_name || '.' || column_name AS source_id, 'http://lake/Big_T' || CAST(t % 50 AS STRING) AS target, 'c2' AS filter_column FROM ({COLUMNS}) c WHERE column_name LIKE 'is%'"


@register(REGISTRY, "val_missing_discriminators", duck("SELECT source_id, 'missing_discriminator_class_rule' AS issue FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE kind = 'class' AND r.target = f.target AND r.filter_column = f.filter_column AND t % 300 = 0)", f=_FILTERS))
def _(spark, d):
    return ops.missing_discriminators(ask(spark, d, _FILTERS), rules(spark, d).filter("t % 300 = 0"))


_TARGETS = "SELECT 'data' AS kind, 't-' || CAST(p_partkey % 40 AS STRING) AS id, 'http://lake/p' || CAST(p_partkey % 40 AS STRING) AS uri FROM part WHERE p_partkey % 40 < 30 UNION ALL SELECT 'data', 't-1', 'http://lake/other' FROM part WHERE p_partkey = 0 UNION ALL SELECT 'class', 't-c', 'http://lake/Big_T' || CAST(p_partkey % 50 AS STRING) FROM part"
_GROUND = "SELECT rule_id, kind, source_table, source_column, CASE WHEN kind = 'data' AND x % 3 = 0 THEN 't-' || CAST(x % 40 AS STRING) ELSE target END AS target FROM r"


@register(
    REGISTRY,
    "val_rule_grounding",
    duck(
        "SELECT rule_id, target FROM (SELECT g.rule_id, g.kind, g.source_table, g.source_column, coalesce(u.uri, g.target) AS target FROM g LEFT JOIN (SELECT kind, id, min(uri) AS uri FROM tg GROUP BY ALL HAVING count(DISTINCT uri) = 1) u ON u.kind = g.kind AND u.id = g.target) z "
        "WHERE (kind, target) IN (SELECT (kind, uri) FROM tg) AND source_table IN (SELECT table_name FROM c) AND (source_column = '' OR (source_table, source_column) IN (SELECT (table_name, column_name) FROM c))",
        tg=_TARGETS,
        g=_GROUND,
    ),
)
def _(spark, d):
    r = rules(spark, d)
    r = r.withColumn("target", F.when((F.col("kind") == "data") & (F.col("x") % 3 == 0), F.concat(F.lit("t-"), (F.col("x") % 40).cast("string"))).otherwise(F.col("target")))
    return ops.grounded(r, columns(spark, d), ask(spark, d, _TARGETS)).select("rule_id", "target")


_PREFIXED = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'class:' WHEN 1 THEN 'data_property:' WHEN 2 THEN 'object_property:' WHEN 3 THEN 'other:' ELSE '' END || CASE p_size % 3 WHEN 0 THEN 'urn:' WHEN 1 THEN 'http://' ELSE 'ftp://' END || p_brand AS raw FROM part"


@register(REGISTRY, "val_role_prefix", f"SELECT id, raw, CASE WHEN id % 5 < 3 AND (contains(raw, ':urn:') OR contains(raw, ':http://')) THEN substr(raw, strpos(raw, ':') + 1) ELSE raw END AS target FROM ({_PREFIXED})")
def _(spark, d):
    return ask(spark, d, _PREFIXED).select("id", "raw", ops.strip_role_prefix(F.col("raw")).alias("target"))


_NAMES = "SELECT p_partkey AS id, p_name AS source_table, 'http://x#' || CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '_') || 's' WHEN 1 THEN 'Conf_' || p_type WHEN 2 THEN replace(p_name, ' ', '-') ELSE 'Big' || p_brand END AS target FROM part"
_LOCAL = "regexp_extract(target, '#(.*)$', 1)"


@register(REGISTRY, "val_class_compat", f"SELECT id, len(list_intersect({words_sql('source_table')}, {words_sql(_LOCAL)})) > 0 AS compatible FROM ({_NAMES})")
def _(spark, d):
    both = F.arrays_overlap(text.word_set(F.col("source_table")), text.word_set(text.local_name(F.col("target"))))
    return ask(spark, d, _NAMES).select("id", both.alias("compatible"))


_SIDE = f"SELECT p_partkey AS id, 'http://x#' || replace(p_name, ' ', '_') AS cls, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://x#' || split_part(p_name, ' ', 2) ELSE 'http://x#' || p_type || ',http://x#' || replace(p_name, ' ', '-') END AS domain FROM part"
_FITS = "CASE WHEN len(list_intersect(a, b)) = len(a) AND len(a) = len(b) THEN 2 WHEN len(list_intersect(a, b)) > 0 THEN 1 ELSE 0 END"


@register(
    REGISTRY,
    "val_domain_range",
    f"SELECT id, CASE WHEN domain = '' THEN 1 ELSE best END AS rules_score, CASE WHEN domain = '' OR id % 4 = 0 THEN 1 ELSE best END AS evidence_score FROM (SELECT id, domain, max({_FITS}) AS best FROM (SELECT id, domain, {words_sql('regexp_extract(cls, chr(35) || chr(40) || chr(46) || chr(42) || chr(41), 1)')} AS a, {words_sql('regexp_extract(one, chr(35) || chr(40) || chr(46) || chr(42) || chr(41), 1)')} AS b FROM (SELECT *, unnest(string_split(domain, ',')) AS one FROM ({_SIDE}))) GROUP BY ALL)",
)
def _(spark, d):
    rows = listed(ask(spark, d, _SIDE), "domain")
    words = text.word_set(text.local_name(F.col("cls")))
    # evidence also takes a side without classes, which is so for every fourth row
    classes = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("cls"))
    return rows.select("id", ops.side_score(words, F.col("domain"), 1).alias("rules_score"), ops.evidence_score(F.col("domain"), classes).alias("evidence_score"))


_MATCHED = f"SELECT 'source-data:' || table_name || '.' || column_name AS source_id, CASE WHEN x % 5 = 0 THEN 'class' ELSE 'data_property' END AS source_kind, CASE WHEN x % 6 = 0 THEN 'class' ELSE 'data_property' END AS target_kind, CASE WHEN x % 7 = 0 THEN NULL WHEN x % 2 = 0 THEN 'http://lake/customerCode' ELSE 'http://lake/label' END AS target, CASE WHEN x % 3 = 0 THEN 'http://lake/' || upper(table_name) ELSE 'http://lake/Other' END AS domain FROM ({COLUMNS}) c"
_ID_WORD = "target = 'http://lake/customerCode'"


@register(
    REGISTRY,
    "val_match_issues",
    duck(
        "SELECT source_id, issue FROM (SELECT source_id, unnest([CASE WHEN source_kind <> target_kind THEN 'kind_mismatch:' || source_kind || '->' || target_kind END, CASE WHEN is_fk AND target_kind = 'data_property' AND NOT id THEN 'fk_column_mapped_to_non_identifier_data_property' END, "
        "CASE WHEN is_fk AND target_kind = 'data_property' AND id AND NOT contains(lower(domain), table_name) THEN 'fk_column_mapped_to_context_mismatched_identifier_property' END, "
        "CASE WHEN (is_fk OR column_name = 'id' OR (is_pk AND column_name LIKE '%\\_id' ESCAPE '\\')) AND target_kind = 'data_property' AND NOT id THEN 'generic_identifier_mapped_to_non_identifier_data_property' END]) AS issue "
        f"FROM (SELECT *, {_ID_WORD} AS id FROM mm WHERE target IS NOT NULL) mm JOIN w ON mm.source_id = 'source-data:' || w.table_name || '.' || w.column_name) WHERE issue IS NOT NULL",
        mm=_MATCHED,
    ),
)
def _(spark, d):
    cols = fk_columns(spark, d).withColumn("column_role", F.when(F.col("is_pk"), "primary_key"))
    return ops.match_issues(ask(spark, d, _MATCHED), cols)


@register(REGISTRY, "val_rules_for_match", duck("SELECT DISTINCT source_id, rule_id FROM (SELECT m.source_id, r.rule_id FROM m JOIN r ON r.target = m.target AND r.t % 40 = 0 WHERE m.source_id LIKE '%7' UNION ALL SELECT m.source_id, r.rule_id FROM m JOIN r ON r.match_ids = m.source_id AND r.t % 40 = 0 WHERE m.target IS NOT NULL AND m.source_id LIKE '%7')"))
def _(spark, d):
    return ops.rules_for_matches(matches(spark, d).filter("target IS NOT NULL AND source_id LIKE '%7'"), rules(spark, d).filter("t % 40 = 0"))


_KIND = "CASE WHEN starts_with(source_id, 'source-data:') THEN 1 ELSE 0 END"


@register(
    REGISTRY,
    "val_mapping_diag",
    duck(
        "SELECT count(*) AS selected_matches, count(*) FILTER (x.target NOT LIKE 'http%') AS invalid_target_uri_count, count(*) FILTER (x.target LIKE 'n%') AS anonymous_target_count, count(*) FILTER (g) AS generic_id_data_matches, count(*) FILTER (role = 'join_table') AS join_table_class_matches, "
        "(SELECT count(*) FROM r WHERE kind = 'class') AS class_rules, (SELECT count(*) FROM r WHERE kind = 'data') AS data_rules, (SELECT count(*) FROM r WHERE kind = 'object') AS object_rules "
        "FROM (SELECT source_id, CASE WHEN length(source_id) % 7 = 0 THEN 'n' || source_id ELSE target END AS target FROM m WHERE target IS NOT NULL) x LEFT JOIN (SELECT 'source-data:' || table_name || '.' || column_name AS source_id, is_fk OR column_name = 'id' OR (is_pk AND column_name LIKE '%\\_id' ESCAPE '\\') AS g FROM w) i USING (source_id) LEFT JOIN (SELECT 'source-class:' || table_name AS source_id, role FROM roles) y USING (source_id)",
        **_MORE,
    ),
)
def _(spark, d):
    m = matches(spark, d).withColumn("target", F.when((F.length("source_id") % 7 == 0) & F.col("target").isNotNull(), F.concat(F.lit("n"), "source_id")).otherwise(F.col("target")))
    c, k = columns(spark, d), keys(spark, d)
    return ops.mapping_diagnostics(m, rules(spark, d), lake.column_roles(c, k), lake.table_roles(c, k))


# --- object plans ------------------------------------------------------------------------------------------------------

_OBJECTS = (
    f"SELECT 'source-object:' || table_name || '.' || column_name AS source_id, table_name AS child, column_name AS columns, CASE x % 4 WHEN 0 THEN '' WHEN 1 THEN 'http://lake/Big_T' || CAST(t % 50 AS STRING) ELSE 'http://lake/Small_T' || CAST((t - t % 8) % 50 AS STRING) END AS domain, "
    f"CASE WHEN y % 2 = 0 THEN '' ELSE 'http://lake/T' || CAST((t - t % 8) % 50 AS STRING) END AS range FROM ({COLUMNS}) c WHERE y % 3 = 0"
)
_CLASSES = f"SELECT table_name, 'http://lake/T' || CAST(t % 50 AS STRING) AS target FROM ({COLUMNS}) c WHERE position = 1 AND x % 4 <> 0"


def _fit(side: str, cls: str) -> str:
    return f"({side} = '' OR {cls} IS NULL OR len(list_intersect({words_sql(f'split_part({side}, chr(47), 4)')}, {words_sql(f'split_part({cls}, chr(47), 4)')})) > 0)"


_PLANS = (
    "SELECT o.source_id, w.orientation, w.a AS subject_table, w.b AS object_table, array_to_string(w.sk, ',') AS subject_columns, array_to_string(w.ok, ',') AS object_columns FROM (SELECT o.*, unnest(["
    "{{'orientation': 'direct_fk', 'a': l.child, 'b': l.parent, 'sk': NULL::VARCHAR[], 'ok': l.cols}}, {{'orientation': 'inverse_fk', 'a': l.parent, 'b': l.child, 'sk': l.cols, 'ok': NULL}}]) AS w FROM o JOIN lists l ON l.child = o.child AND l.cols = [o.columns] "
    "UNION ALL SELECT o.*, unnest([{{'orientation': 'join_subject_matched_fk', 'a': l.parent, 'b': z.parent, 'sk': l.cols, 'ok': z.cols}}, {{'orientation': 'join_object_matched_fk', 'a': z.parent, 'b': l.parent, 'sk': z.cols, 'ok': l.cols}}]) FROM o JOIN lists l ON l.child = o.child AND l.cols = [o.columns] JOIN lists z ON z.child = l.child AND z.cols <> l.cols) o "
    "LEFT JOIN cl sc ON sc.table_name = w.a LEFT JOIN cl oc ON oc.table_name = w.b WHERE {subject} AND {object}"
).format(subject=_fit("o.domain", "sc.target"), object=_fit("o.range", "oc.target"))
_PLANNED = _MORE | {"o": _OBJECTS, "cl": _CLASSES}


def object_plans(spark, d):
    return ops.object_plans(listed(ask(spark, d, _OBJECTS), "columns", "domain", "range"), lake.key_lists(keys(spark, d)), ask(spark, d, _CLASSES), lake.table_roles(columns(spark, d), keys(spark, d)))


@register(REGISTRY, "val_legal_plans", duck(_PLANS, **_PLANNED))
def _(spark, d):
    p = object_plans(spark, d)
    return p.select("source_id", "orientation", "subject_table", "object_table", F.array_join("subject_columns", ",").alias("subject_columns"), F.array_join("object_columns", ",").alias("object_columns"))


@register(REGISTRY, "val_plan_summary", duck(f"SELECT CASE WHEN orientation LIKE 'join%' THEN 'join_table' WHEN orientation = 'inverse_fk' THEN 'reverse_fk' ELSE 'direct_fk' END AS confidence_label, count(*) AS plans, count(DISTINCT source_id) AS matches FROM ({_PLANS}) GROUP BY 1", **_PLANNED))
def _(spark, d):
    return object_plans(spark, d).groupBy("confidence_label").agg(F.count("*").alias("plans"), F.count_distinct("source_id").alias("matches"))


_FAULT = "CASE WHEN n % 7 = 0 THEN 'none' WHEN n % 7 = 1 THEN 'unknown' WHEN n % 7 = 2 THEN 'target_table' WHEN n % 7 = 3 THEN 'source_table' ELSE 'good' END"


@register(
    REGISTRY,
    "val_plan_conformance",
    duck(
        f"SELECT orientation, issue, field, count(*) AS n FROM (SELECT orientation, unnest(CASE n % 7 WHEN 0 THEN [{{'issue': 'missing_object_plan_id', 'field': ''}}] WHEN 1 THEN [{{'issue': 'unknown_object_plan_id', 'field': ''}}] WHEN 2 THEN [{{'issue': 'object_rule_does_not_match_plan', 'field': 'subject_table'}}] WHEN 3 THEN [{{'issue': 'object_rule_does_not_match_plan', 'field': 'object_columns'}}, {{'issue': 'object_rule_does_not_match_plan', 'field': 'source_table'}}] ELSE [] END "
        f"|| CASE WHEN n % 7 > 1 AND n % 5 = 0 THEN [{{'issue': 'object_plan_zero_reachability', 'field': ''}}] ELSE [] END, recursive := true) FROM (SELECT *, length(source_id) + length(subject_table) + length(object_table) AS n FROM ({_PLANS}))) GROUP BY ALL",
        **_PLANNED,
    ),
)
def _(spark, d):
    p = object_plans(spark, d).withColumn("n", F.length("source_id") + F.length("subject_table") + F.length("object_table"))
    plans = p.withColumn("source_rows", F.lit(9)).withColumn("estimated_emissions", F.when(F.col("n") % 5 == 0, 0).otherwise(4))
    fault = F.col("n") % 7
    r = p.withColumn("rule_id", F.concat_ws("/", "source_id", "plan_id"))
    r = r.withColumn("plan_id", F.when(fault == 1, F.concat(F.lit("?"), "plan_id")).when(fault != 0, F.col("plan_id")))
    r = r.withColumn("subject_table", F.when(fault == 2, "other").otherwise(F.col("subject_table"))).withColumn("source_table", F.when(fault == 3, "other").otherwise(F.col("source_table"))).withColumn("object_columns", F.when(fault == 3, F.array(F.lit("odd"))).otherwise(F.col("object_columns")))
    found = ops.plan_conformance(r, plans)
    return found.join(r.select("rule_id", "orientation"), "rule_id").groupBy("orientation", "issue", "field").agg(F.count("*").alias("n"))


# --- coverage ----------------------------------------------------------------------------------------------------------

_DATA = "(SELECT * FROM m WHERE target IS NOT NULL AND starts_with(source_id, 'source-data:'))"
_SUPPORT = f"SELECT r.rule_id, s.source_id FROM r JOIN {_DATA} s ON s.source_id = r.match_ids OR (s.table_name = r.source_table AND s.column_name = r.source_column AND s.target = r.target) WHERE r.kind = 'data'"
_VALID = "r.match_ids IN (SELECT source_id FROM m WHERE target IS NOT NULL)"
_ATTRIBUTE = (
    "SELECT rule_id AS id, issue FROM (SELECT rule_id, unnest(CASE WHEN source_table = 'ghost' THEN ['data_rule_unknown_source_table'] ELSE [CASE WHEN source_column = 'nope' THEN 'data_rule_unknown_source_column' END, "
    f"CASE WHEN target NOT IN (SELECT target FROM {_DATA}) THEN 'data_rule_target_not_selected' END, CASE WHEN NOT {_VALID} THEN 'literal_provenance_missing' END, CASE WHEN {_VALID} AND rule_id NOT IN (SELECT rule_id FROM sup) THEN 'literal_provenance_too_broad' END, "
    "CASE WHEN subject_table = '' AND (source_table, source_column) IN (SELECT (child, column_name) FROM k) THEN 'fk_like_data_rule' END] END) AS issue FROM r WHERE kind = 'data') WHERE issue IS NOT NULL "
    f"UNION ALL SELECT 'attribute:' || source_id, 'missing_data_rule' FROM {_DATA} WHERE source_id NOT IN (SELECT source_id FROM sup) UNION ALL SELECT 'attribute:' || source_id, 'fk_like_selected_datatype_match' FROM {_DATA} s WHERE (table_name, column_name) IN (SELECT (child, column_name) FROM k)"
)


@register(REGISTRY, "val_attr_coverage", duck(_ATTRIBUTE, sup=_SUPPORT))
def _(spark, d):
    return coverage.attribute_issues(rules(spark, d), matches(spark, d), fk_columns(spark, d))


@register(
    REGISTRY,
    "val_attr_summary",
    duck(f"SELECT (SELECT count(*) FROM {_DATA}) AS selected_datatype_matches, count(*) FILTER (issue = 'missing_data_rule') AS datatype_matches_missing_rules, count(*) FILTER (issue = 'fk_like_data_rule') AS fk_like_data_rules, count(*) AS issues, (SELECT count(*) FROM {_DATA} WHERE source_id IN (SELECT source_id FROM sup)) AS datatype_matches_with_rules FROM ({_ATTRIBUTE})", sup=_SUPPORT),
)
def _(spark, d):
    return coverage.attribute_summary(rules(spark, d), matches(spark, d), fk_columns(spark, d))


#: What a run emitted: facts by target, looked-at literals, source values, and how rules fared.
_COUNTS = "SELECT iri, class_triples, predicate_triples FROM (SELECT 'http://lake/p' || CAST(p_partkey % 40 AS STRING) AS iri, 0 AS class_triples, sum(CASE WHEN p_partkey % 40 < 5 THEN 0 ELSE p_size END) AS predicate_triples FROM part GROUP BY p_partkey % 40 UNION ALL SELECT 'http://lake/Big_T' || CAST(p_partkey % 50 AS STRING), sum(CASE WHEN p_partkey % 50 < 9 THEN 0 ELSE 1 END), 0 FROM part GROUP BY p_partkey % 50) q"
_LITERALS = "SELECT 'http://lake/p' || CAST(p_partkey % 40 AS STRING) AS iri, 8 AS samples, p_partkey % 40 % 9 AS identifier_like FROM part GROUP BY p_partkey % 40"
_VALUES = f"SELECT table_name, column_name, 20 + t % 30 AS row_count, x % 25 AS non_empty_count FROM ({COLUMNS}) c"
_STATS = f"SELECT CASE WHEN position = 1 THEN 'class' WHEN y % 2 = 0 THEN 'data' ELSE 'object' END || ':' || CAST(t * 10 + position AS STRING) AS rule_id, x % 3 AS reachable_rows, x % 4 AS helper_calls, x % 5 AS emitted, y % 2 AS missing_rows FROM ({COLUMNS}) c WHERE x % 7 <> 0"
#: Matches whose columns' names tell of text.
_TEXTS = "SELECT source_id, match_type, table_name, column_name, target FROM m"
_N = "coalesce(CASE WHEN m.match_type = 'class' THEN class_triples ELSE predicate_triples END, 0)"
_GUARD = "greatest(20, 3 * CASE WHEN non_empty_count > 0 THEN non_empty_count ELSE row_count END)"
_IS_TEXT = "regexp_matches(lower(m.table_name || '_' || m.column_name), 'name|title|text')"
_READS = "SELECT rule_id, source_table, unnest(CASE WHEN kind = 'data' THEN [source_column] ELSE [x for x in [source_columns, subject_columns, object_columns] if x <> ''] END) AS column_name FROM r"
_EMISSION = (
    f"SELECT source_id AS id, issue FROM (SELECT source_id, unnest([CASE WHEN {_N} = 0 THEN 'selected_target_zero_emission' END, CASE WHEN {_IS_TEXT} AND {_N} = 0 THEN 'text_like_selected_evidence_missing_literals' END, CASE WHEN {_IS_TEXT} AND {_N} > 0 AND samples > 0 AND identifier_like >= 0.75 * samples THEN 'text_like_literal_identifier_like' END, "
    f"CASE WHEN row_count IS NOT NULL AND {_N} > {_GUARD} THEN 'overbroad_emission' END]) AS issue FROM mt m LEFT JOIN counts ON counts.iri = m.target LEFT JOIN literals ON literals.iri = m.target LEFT JOIN vals ON vals.table_name = m.table_name0 AND vals.column_name = m.column_name0 WHERE m.target IS NOT NULL) WHERE issue IS NOT NULL "
    "UNION ALL SELECT rule_id, issue FROM (SELECT r.rule_id, unnest([CASE WHEN source_table = 'ghost' THEN 'unknown_source_table' END, CASE WHEN kind = 'data' AND subject_table = '' AND (source_table, source_column) IN (SELECT (child, column_name) FROM k) THEN 'fk_like_datatype_literal_without_justification' END, "
    "CASE WHEN reachable_rows > 0 AND emitted = 0 THEN 'reachable_rule_zero_emission' END, CASE WHEN reachable_rows > 0 AND helper_calls = 0 THEN 'generated_code_path_zero_helper_calls' END, CASE WHEN missing_rows > 0 AND emitted = 0 THEN 'zero_row_join' END]) AS issue FROM r LEFT JOIN stats ON stats.rule_id = r.rule_id) WHERE issue IS NOT NULL "
    "UNION ALL SELECT rule_id, 'unknown_source_column' FROM reads WHERE source_table <> 'ghost' AND (source_table, column_name) NOT IN (SELECT (table_name, column_name) FROM c)"
)
_MT = "SELECT source_id, match_type, target, table_name AS table_name0, column_name AS column_name0, table_name, CASE WHEN column_name LIKE '%3%' THEN column_name || '_title' ELSE column_name END AS column_name FROM m"
_EMITTED = {"counts": _COUNTS, "literals": _LITERALS, "vals": _VALUES, "stats": _STATS, "mt": _MT, "reads": _READS}


def emission(spark, d):
    title = lambda c: F.when(F.col(c).contains("3"), F.concat(F.col(c), F.lit("_title"))).otherwise(F.col(c))
    m = matches(spark, d).withColumn("column_name", title("column_name"))
    values = ask(spark, d, _VALUES).withColumn("column_name", title("column_name"))
    r = rules(spark, d)
    r = r.withColumn("columns", F.when(F.col("kind") == "data", F.array("source_column")).otherwise(F.concat("source_columns", "subject_columns", "object_columns")))
    found = coverage.emission_issues(m, r, fk_columns(spark, d), ask(spark, d, _COUNTS), ask(spark, d, _LITERALS), values, ask(spark, d, _STATS))
    return found, m


@register(REGISTRY, "val_emission_issues", duck(_EMISSION, **_EMITTED))
def _(spark, d):
    return emission(spark, d)[0]


@register(
    REGISTRY,
    "val_emission_summary",
    duck(
        "SELECT count(*) AS issue_count, count(*) FILTER (issue = 'selected_target_zero_emission') AS zero_emission_selected_targets, count(*) FILTER (issue LIKE 'unknown_source_%') AS unknown_reference_issues, count(*) FILTER (issue LIKE 'fk_like_datatype%') AS fk_like_literal_issues, count(*) FILTER (issue = 'overbroad_emission') AS overbroad_issues, count(*) FILTER (issue = 'reachable_rule_zero_emission') AS zero_rule_issues, count(*) FILTER (issue LIKE 'generated%') AS zero_branch_issues, "
        f"(SELECT count(*) FROM m WHERE target IS NOT NULL) AS selected_target_count, (SELECT count(*) FROM m WHERE target IS NOT NULL) - count(*) FILTER (issue = 'selected_target_zero_emission') AS selected_targets_with_emission, 3 AS invalid_triple_count, 7 AS generated_triples FROM ({_EMISSION})",
        **_EMITTED,
    ),
)
def _(spark, d):
    found, m = emission(spark, d)
    return coverage.emission_summary(found, m, 7, 3)


_ACTIONS = (
    f"SELECT t * 10 + position AS action_id, CASE x % 5 WHEN 0 THEN 'drop' WHEN 1 THEN 'repair' WHEN 2 THEN 'add_data_rule' WHEN 3 THEN 'keep_with_justification' ELSE 'odd' END AS action, CASE WHEN y % 9 = 0 THEN NULL ELSE t * 10 + position END AS position, x % 4 <> 0 AS has_rule, table_name AS source_table, column_name AS source_column, "
    f"'http://lake/p' || CAST(x % 40 AS STRING) AS target, CASE WHEN y % 4 = 0 THEN '' ELSE 'source-data:' || table_name || '.' || column_name END AS match_ids FROM ({COLUMNS}) c WHERE position > 1"
)
_ACTED = f"SELECT a.*, EXISTS (SELECT 1 FROM {_DATA} s WHERE s.source_id = a.match_ids AND s.target = a.target) AS ground, position IN (SELECT number FROM r WHERE kind = 'data') AS there FROM a"
_WHY = "CASE WHEN action = 'repair' AND has_rule AND there AND NOT ground THEN 'ungrounded_repaired_rule' WHEN action = 'add_data_rule' AND has_rule AND NOT ground THEN 'ungrounded_added_rule' WHEN (action = 'drop' AND there) OR (action = 'repair' AND has_rule AND there) OR (action = 'add_data_rule' AND has_rule) OR action = 'keep_with_justification' THEN NULL ELSE 'unsupported_action_or_missing_rule' END"
_REPAIR = {"a": _ACTIONS, "acted": _ACTED, "judged": f"SELECT *, {_WHY} AS reason FROM acted"}


def repaired(spark, d):
    r = rules(spark, d).filter("kind = 'data'").select(F.col("number").alias("position"), "source_table", "source_column", "target", "match_ids")
    return coverage.repairs(r, listed(ask(spark, d, _ACTIONS), "match_ids"), matches(spark, d), columns(spark, d))


@register(
    REGISTRY,
    "val_apply_repairs",
    duck(
        "SELECT r.number AS position, CASE WHEN j.action IS NULL THEN r.source_table ELSE j.source_table END AS source_table, CASE WHEN j.action IS NULL THEN r.source_column ELSE j.source_column END AS source_column, CASE WHEN j.action IS NULL THEN r.target ELSE j.target END AS target FROM r LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL AND action IN ('drop', 'repair')) j ON j.position = r.number "
        "WHERE r.kind = 'data' AND coalesce(j.action, '') <> 'drop' UNION ALL SELECT NULL, source_table, source_column, target FROM judged WHERE reason IS NULL AND action = 'add_data_rule'",
        **_REPAIR,
    ),
)
def _(spark, d):
    return repaired(spark, d)[0].select("position", "source_table", "source_column", "target")


@register(REGISTRY, "val_rejected_repairs", duck("SELECT action_id, action, reason FROM judged WHERE reason IS NOT NULL", **_REPAIR))
def _(spark, d):
    return repaired(spark, d)[1]


# --- changes of rules --------------------------------------------------------------------------------------------------

_AFTER = "SELECT * FROM r WHERE x % 10 <> 3 UNION ALL SELECT * REPLACE ('http://lake/new' AS target) FROM r WHERE x % 25 = 0"
_PARTS = ["kind", "source_table", "target"]


def before_after(spark, d):
    r = rules(spark, d)
    return r, r.filter("x % 10 <> 3").unionByName(r.filter("x % 25 = 0").withColumn("target", F.lit("http://lake/new")))


@register(REGISTRY, "val_rule_merge", duck("SELECT kind, source_table, target, min(number) AS position FROM r GROUP BY ALL"))
def _(spark, d):
    merged = ops.merge_rules(rules(spark, d), _PARTS, "number")
    body = F.from_json("rule", "kind string, source_table string, target string")
    return merged.select(body.alias("b"), "position").select("b.*", "position")


@register(REGISTRY, "val_rule_diff", duck("SELECT *, 'dropped' AS change FROM (SELECT kind, source_table, target FROM r EXCEPT ALL SELECT kind, source_table, target FROM after) UNION ALL SELECT *, 'added' FROM (SELECT kind, source_table, target FROM after EXCEPT ALL SELECT kind, source_table, target FROM r)", after=_AFTER))
def _(spark, d):
    a, b = (x.select(*_PARTS) for x in before_after(spark, d))
    return ops.diff(a, b)


@register(REGISTRY, "val_coverage_diff", duck("SELECT count(b) AS before, count(a) AS after, count(*) FILTER (a IS NULL) AS dropped, count(*) FILTER (b IS NULL) AS added, round(count(*) FILTER (a IS NULL) / count(b), 6) AS drop_ratio FROM (SELECT DISTINCT target AS b FROM r) FULL JOIN (SELECT DISTINCT target AS a FROM after) ON a = b", after=_AFTER))
def _(spark, d):
    a, b = before_after(spark, d)
    return ops.coverage_diff(a, b).withColumn("drop_ratio", F.round("drop_ratio", 6))


@register(REGISTRY, "val_source_diff", duck("SELECT source_table, source_column, coalesce(n, 0) AS before, coalesce(q, 0) AS after FROM (SELECT source_table, source_column, count(*) AS n FROM r GROUP BY ALL) FULL JOIN (SELECT source_table, source_column, count(*) AS q FROM after GROUP BY ALL) USING (source_table, source_column) WHERE coalesce(n, 0) <> coalesce(q, 0)", after=_AFTER))
def _(spark, d):
    return ops.usage_diff(*before_after(spark, d), ["source_table", "source_column"])


_LOST = "SELECT count(*) FROM (SELECT DISTINCT {k} FROM r WHERE {w}) x WHERE NOT EXISTS (SELECT 1 FROM after WHERE {w} AND {on})"


@register(
    REGISTRY,
    "val_preservation_gate",
    duck(
        "SELECT *, lost_targets + lost_filters + lost_objects = 0 AS accepted FROM (SELECT "
        + ", ".join(f"({_LOST.format(k=k, w=w, on=' AND '.join(f'after.{c} = x.{c}' for c in k.split(', ')))}) AS {n}" for n, k, w in (("lost_targets", "target", "TRUE"), ("lost_filters", "target, filter_column", "filter_column IS NOT NULL"), ("lost_objects", "target, source_table, target_table", "kind = 'object'")))
        + ")",
        after=_AFTER,
    ),
)
def _(spark, d):
    return ops.preservation_gate(*before_after(spark, d))


@register(REGISTRY, "val_preservation_overlay", duck("SELECT kind, source_table, target FROM after UNION ALL SELECT kind, source_table, target FROM r WHERE target NOT IN (SELECT target FROM after) AND (SELECT count(DISTINCT target) FROM r WHERE target NOT IN (SELECT target FROM after)) > 0.001 * (SELECT count(DISTINCT target) FROM r)", after=_AFTER))
def _(spark, d):
    a, b = (x.select(*_PARTS) for x in before_after(spark, d))
    return ops.overlay(a, b, 0.001)


_ROUND2 = f"SELECT number, action, kind, CASE WHEN y % 9 = 0 THEN NULL ELSE position END AS position, CASE WHEN x % 8 = 0 THEN NULL ELSE 'new' || CAST(x AS STRING) END AS rule FROM (SELECT t * 10 + position AS number, CASE x % 5 WHEN 0 THEN 'drop' WHEN 1 THEN 'repair' WHEN 2 THEN 'add_class_rule' WHEN 3 THEN 'add_data_rule' ELSE 'keep_with_justification' END AS action, CASE WHEN y % 2 = 0 THEN 'class' ELSE 'data' END AS kind, t % 400 AS position, x, y FROM ({COLUMNS}) c WHERE t % 20 = 0) q"
_LISTED = "SELECT 'class' AS kind, p_partkey AS position, p_name AS rule FROM part WHERE p_partkey < 300 UNION ALL SELECT 'data', p_partkey, p_type FROM part WHERE p_partkey < 200"


@register(
    REGISTRY,
    "val_round2",
    duck(
        "SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY late, spot) - 1 AS position, rule FROM (SELECT l.kind, 0 AS late, l.position AS spot, coalesce(p.rule, l.rule) AS rule FROM li l LEFT JOIN (SELECT kind, position, max_by(rule, number) AS rule FROM acts WHERE action = 'repair' AND rule IS NOT NULL AND position IS NOT NULL GROUP BY ALL) p ON p.kind = l.kind AND p.position = l.position WHERE NOT EXISTS (SELECT 1 FROM acts a WHERE a.action = 'drop' AND a.kind = l.kind AND a.position = l.position) "
        "UNION ALL SELECT CASE action WHEN 'add_class_rule' THEN 'class' WHEN 'add_data_rule' THEN 'data' ELSE kind END, 1, number, rule FROM acts WHERE rule IS NOT NULL AND (action LIKE 'add%' OR (action = 'repair' AND position IS NULL)))",
        acts=_ROUND2,
        li=_LISTED,
    ),
)
def _(spark, d):
    return coverage.round2(ask(spark, d, _LISTED), ask(spark, d, _ROUND2))


_TEMPLATED = "SELECT kind, source_table, target, CASE WHEN kind = 'class' THEN 'c1' END AS id_columns FROM r"
_RETEMPLATED = "SELECT kind, source_table, target, CASE WHEN kind = 'class' THEN CASE WHEN x % 9 = 0 THEN 'c2' ELSE 'c1' END END AS id_columns FROM after"


def templated(spark, d):
    b, a = before_after(spark, d)
    is_class = F.col("kind") == "class"
    return b.withColumn("id_columns", F.when(is_class, "c1")), a.withColumn("id_columns", F.when(is_class, F.when(F.col("x") % 9 == 0, "c2").otherwise("c1")))


_CHANGES = "SELECT b.source_table, b.target, CASE WHEN a.i IS NULL THEN 'missing_in_new' ELSE 'id_columns_changed' END AS reason FROM (SELECT source_table, target, max(id_columns) AS i FROM tb WHERE kind = 'class' GROUP BY ALL) b LEFT JOIN (SELECT source_table, target, max(id_columns) AS i FROM ta WHERE kind = 'class' GROUP BY ALL) a ON a.source_table = b.source_table AND a.target = b.target WHERE a.i IS NULL OR a.i <> b.i"
_TEMPLATES2 = {"after": _AFTER, "tb": _TEMPLATED, "ta": _RETEMPLATED}


@register(REGISTRY, "val_template_diff", duck(_CHANGES, **_TEMPLATES2))
def _(spark, d):
    return coverage.template_changes(*templated(spark, d))


@register(
    REGISTRY,
    "val_replacement_reasons",
    duck(
        " UNION ALL ".join(f"SELECT '{k}_target_coverage_drop_gt_0.02' AS reason FROM (SELECT count(*) FILTER (target NOT IN (SELECT target FROM ta WHERE {w})) / greatest(1, count(*)) AS r FROM (SELECT DISTINCT target FROM tb WHERE {w})) WHERE r > 0.02" for k, w in (("all", "TRUE"), ("class", "kind = 'class'"), ("data", "kind = 'data'"), ("object", "kind = 'object'")))
        + f" UNION ALL SELECT 'uri_template_changed_or_missing' FROM (SELECT count(*) AS n FROM ({_CHANGES})) WHERE n > 0",
        **_TEMPLATES2,
    ),
)
def _(spark, d):
    return coverage.preservation(*templated(spark, d))


_UNSAFE = "CASE WHEN source_table = 'ghost' THEN 'unknown_source_table' WHEN kind = 'class' AND x % 7 = 0 THEN 'unknown_class_id_column' WHEN kind = 'data' AND source_column = 'nope' THEN 'unknown_data_source_column' WHEN kind = 'data' AND (source_table, source_column) IN (SELECT (child, column_name) FROM k) THEN 'fk_like_literal_without_identifier_target' "
_UNSAFE += "WHEN kind = 'object' AND target_table NOT IN (SELECT table_name FROM c) THEN 'unknown_object_target_table' WHEN kind = 'object' AND (target_table, target_columns) NOT IN (SELECT (table_name, column_name) FROM c) THEN 'unknown_object_target_column' END"


@register(REGISTRY, "val_safe_rules", duck(f"SELECT rule_id, reason FROM (SELECT rule_id, {_UNSAFE} AS reason FROM r) WHERE reason IS NOT NULL"))
def _(spark, d):
    r = rules(spark, d).withColumn("id_columns", F.when((F.col("kind") == "class") & (F.col("x") % 7 == 0), F.array(F.lit("lost"))).otherwise(F.array().cast("array<string>")))
    return coverage.safe_rules(r, fk_columns(spark, d))


@register(REGISTRY, "val_ordered_distinct", duck("SELECT kind, target, min(number) AS number FROM r GROUP BY ALL"))
def _(spark, d):
    return coverage.ordered_distinct(rules(spark, d), ["kind", "target"], "number")


@register(REGISTRY, "rep_run_counts", duck("SELECT a.s AS scenario, no_match_rate, greatest(0, accepted - coalesce(n, 0)) AS invalid_rule_count FROM (SELECT length(source_id) AS s, round(avg(CASE WHEN target IS NULL THEN 1.0 ELSE 0 END), 6) AS no_match_rate, count(target) AS accepted FROM m GROUP BY 1) a LEFT JOIN (SELECT length(rule_id) AS s, count(*) AS n FROM r GROUP BY 1) b ON a.s = b.s"))
def _(spark, d):
    m = matches(spark, d).withColumn("scenario", F.length("source_id"))
    return coverage.run_counts(m, rules(spark, d).withColumn("scenario", F.length("rule_id")), "scenario").withColumn("no_match_rate", F.round("no_match_rate", 6))


#: Cells of small tables: values of their columns.
_CELLS = "SELECT 't' || CAST(l_orderkey - l_orderkey % 40 AS STRING) AS table_name, CASE l_linenumber % 4 WHEN 0 THEN 'is_new' WHEN 1 THEN 'type' WHEN 2 THEN 'flag' ELSE 'name' END AS column_name, CASE l_linenumber % 4 WHEN 1 THEN CAST(l_partkey % (1 + l_orderkey / 40 % 12) AS STRING) WHEN 3 THEN 'x' ELSE CASE WHEN l_orderkey % 80 < 40 AND l_partkey % 2 = 0 THEN ' Yes' ELSE '0' END END AS value FROM lineitem"
_KINDED = "SELECT DISTINCT 't' || CAST(l_orderkey - l_orderkey % 40 AS STRING) AS table_name, CASE l_linenumber % 4 WHEN 0 THEN 'is_new' WHEN 1 THEN 'type' WHEN 2 THEN 'flag' ELSE 'name' END AS column_name, CASE WHEN l_linenumber % 4 = 2 THEN 'boolean' ELSE 'text' END AS datatype FROM lineitem UNION ALL SELECT 'empty', 'is_there', 'text' FROM region WHERE r_regionkey = 0"


@register(
    REGISTRY,
    "prof_discriminator_rows",
    f"WITH x AS ({_CELLS.replace('l_orderkey / 40 % 12', 'l_orderkey // 40 % 12')}), g AS (SELECT table_name, column_name, count(DISTINCT value) AS n, max(CASE WHEN lower(trim(value)) IN ('1', 't', 'true', 'yes', 'y') THEN 1 ELSE 0 END) AS yes FROM x GROUP BY ALL) SELECT 'source-discriminator:' || table_name || '.' || column_name AS source_id, table_name, column_name, TRUE AS truthy, NULL AS equals FROM g WHERE column_name IN ('is_new', 'flag') AND yes = 1 "
    "UNION ALL SELECT 'source-discriminator:empty.is_there', 'empty', 'is_there', TRUE, NULL UNION ALL SELECT DISTINCT 'source-discriminator:' || x.table_name || '.type:' || value, x.table_name, 'type', FALSE, value FROM x JOIN g ON g.table_name = x.table_name AND g.column_name = 'type' AND g.n BETWEEN 2 AND 8 WHERE x.column_name = 'type'",
)
def _(spark, d):
    cells = ask(spark, d, _CELLS.replace("l_orderkey / 40 % 12", "l_orderkey DIV 40 % 12"))
    return lake.discriminators(ask(spark, d, _KINDED), cells)


_RATES = f"SELECT table_name, column_name, CASE WHEN x % 3 = 0 THEN 0.0 ELSE 0.5 END AS null_rate, CASE WHEN y % 2 = 0 THEN 1.0 ELSE 0.5 END AS distinct_ratio, x % 4 / 4.0 AS identifier_likeness FROM ({COLUMNS}) c"


@register(
    REGISTRY,
    "prof_uri_templates",
    f"WITH c AS (SELECT table_name, position, column_name, is_pk AND t % 2 = 0 AS is_pk, x, y, t FROM ({COLUMNS}) c), k AS ({KEYS}), rt AS ({_RATES}), lists AS ({_LISTS}), pks AS ({_PK}), parents AS ({_PARENT}), "
    "o AS (SELECT table_name, list(column_name ORDER BY position) FILTER (is_pk) AS pk, min_by(column_name, position) AS first FROM c GROUP BY 1), u AS (SELECT table_name, column_name FROM (SELECT c.table_name, c.column_name, row_number() OVER (PARTITION BY c.table_name ORDER BY identifier_likeness DESC, position) AS r FROM c JOIN rt USING (table_name, column_name) WHERE null_rate = 0 AND distinct_ratio >= 0.98) WHERE r = 1) "
    "SELECT table_name, array_to_string(ids, ',') AS id_columns, reason, 'urn:base:s/' || table_name || '/' || array_to_string(list_transform(ids, lambda z: '{' || z || '}'), '_') AS uri_template FROM (SELECT o.table_name, CASE WHEN pk IS NOT NULL THEN pk WHEN u.column_name IS NOT NULL THEN [u.column_name] ELSE [first] END AS ids, "
    "CASE WHEN o.table_name IN (SELECT child FROM parents) THEN 'subclass_pkfk_parent_identity' WHEN pk IS NOT NULL THEN 'primary_key' WHEN u.column_name IS NOT NULL THEN 'unique_non_null_profile' ELSE 'fallback_table_key' END AS reason FROM o LEFT JOIN u USING (table_name))",
)
def _(spark, d):
    c = columns(spark, d).withColumn("is_pk", F.col("is_pk") & (F.col("t") % 2 == 0))
    return lake.uri_templates(c, keys(spark, d), ask(spark, d, _RATES), "s", "urn:base:")


# --- requests ----------------------------------------------------------------------------------------------------------

@register(REGISTRY, "val_chunks_by_table", duck("SELECT source_id, chunk FROM (SELECT m.source_id, (row_number() OVER (PARTITION BY m.table_name ORDER BY m.source_id) - 1) // 3 AS chunk FROM m WHERE m.table_name IS NOT NULL)"))
def _(spark, d):
    # groups within their own table: every table's chunks are numbered from 0
    m = matches(spark, d).filter("table_name IS NOT NULL").withColumn("part", F.col("table_name"))
    return requests.chunked(m, "part", "source_id", 3, within="table_name").select("source_id", "chunk")


@register(
    REGISTRY,
    "val_chunks_by_component",
    f"WITH RECURSIVE g AS (SELECT CAST(o_custkey AS BIGINT) AS comp, o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY grp) AS i FROM g), "
    "f AS (SELECT comp, grp, i, CAST(CASE WHEN n > 4 THEN 0 ELSE 0 END AS BIGINT) AS first, CAST(CASE WHEN n > 4 THEN ceil(n / 4) ELSE 0 END AS BIGINT) AS number, CAST(CASE WHEN n > 4 THEN 0 ELSE n END AS BIGINT) AS held FROM s WHERE i = 1 UNION ALL "
    "SELECT s.comp, s.grp, s.i, CAST(CASE WHEN s.n > 4 THEN number + CASE WHEN held > 0 THEN 1 ELSE 0 END WHEN held > 0 AND held + s.n > 4 THEN number + 1 ELSE number END AS BIGINT), CAST(CASE WHEN s.n > 4 THEN number + CASE WHEN held > 0 THEN 1 ELSE 0 END + ceil(s.n / 4) WHEN held > 0 AND held + s.n > 4 THEN number + 1 ELSE number END AS BIGINT), CAST(CASE WHEN s.n > 4 THEN 0 WHEN held > 0 AND held + s.n > 4 THEN s.n ELSE held + s.n END AS BIGINT) FROM f JOIN s ON s.comp = f.comp AND s.i = f.i + 1) "
    "SELECT o_orderkey, first + (row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1) // 4 AS chunk FROM orders JOIN f ON comp = o_custkey AND grp = o_orderpriority",
)
def _(spark, d):
    rows = ask(spark, d, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
    return requests.chunked(rows, "o_orderpriority", "o_orderkey", 4, within="o_custkey").select("o_orderkey", "chunk")


@register(REGISTRY, "val_siblings", duck("SELECT table_name, string_agg(target, ' ' ORDER BY source_id) AS siblings FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY source_id) AS i FROM m WHERE table_name IS NOT NULL AND target IS NOT NULL) WHERE i <= 2 GROUP BY table_name"))
def _(spark, d):
    m = matches(spark, d).filter("table_name IS NOT NULL")
    return requests.siblings(m, "table_name", "source_id", 2).select("table_name", F.array_join("siblings", " ").alias("siblings"))


_USAGE = "SELECT event_id, CAST(event_id % 100 AS STRING) AS a, CASE WHEN event_id % 9 = 0 THEN 'many' ELSE CAST(user_id AS STRING) END AS b FROM events"


@register(REGISTRY, "val_usage_totals", f"SELECT 'input_tokens' AS counter, sum(CAST(a AS BIGINT)) AS total FROM ({_USAGE}) UNION ALL SELECT 'output_tokens', sum(try_cast(b AS BIGINT)) FROM ({_USAGE})")
def _(spark, d):
    usage = ask(spark, d, _USAGE).withColumn("usage", F.create_map(F.lit("input_tokens"), "a", F.lit("output_tokens"), "b"))
    return requests.usage_totals(usage, "usage")


_HALVES = "SELECT CAST(o_custkey AS BIGINT) AS c, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 90 AS size FROM orders"


@register(
    REGISTRY,
    "val_budget_halves",
    f"WITH RECURSIVE h AS ({_HALVES}), p AS (SELECT c, list(o_orderkey ORDER BY o_orderkey) AS ids, list(size ORDER BY o_orderkey) AS sizes, '' AS part FROM h GROUP BY c UNION ALL SELECT c, CASE WHEN d = 0 THEN ids[1:len(ids) // 2] ELSE ids[len(ids) // 2 + 1:] END, CASE WHEN d = 0 THEN sizes[1:len(sizes) // 2] ELSE sizes[len(sizes) // 2 + 1:] END, part || d FROM p, (VALUES (0), (1)) x(d) WHERE list_sum(sizes) > 200) "
    "SELECT unnest(ids) AS o_orderkey, part FROM p WHERE list_sum(sizes) <= 200",
)
def _(spark, d):
    return requests.halved(ask(spark, d, _HALVES), "c", "o_orderkey", "size", 200).select("o_orderkey", "part")


# --- names, kinds and answers --------------------------------------------------------------------------------------------

_CLASSNAMES = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'is_' || replace(p_name, ' ', '_') WHEN 1 THEN 'author_paper_student' WHEN 2 THEN 'Is_author_of_paper-x' WHEN 3 THEN replace(p_name, ' ', '-') || '_student' ELSE replace(p_name, ' ', '__') END AS name FROM part"
_BARE = "CASE WHEN lower(name) LIKE 'is\\_%' ESCAPE '\\' THEN substr(name, 4) WHEN lower(name) = 'author_paper_student' THEN 'Author_of_paper_student' ELSE array_to_string(list_transform(list_filter(string_split(replace(name, '-', '_'), '_'), lambda w: w <> ''), lambda w: upper(w[1]) || substr(w, 2)), '_') END"


@register(REGISTRY, "prof_discriminator_classes", f"SELECT p_partkey, array_to_string([b] || CASE WHEN starts_with(f, 'author_of_paper') THEN list_filter(['Author_of_paper', 'Author'], lambda z: z <> b) ELSE [] END || CASE WHEN f LIKE '%\\_student' ESCAPE '\\' OR f = 'student' THEN ['Student'] ELSE [] END, ',') AS classes FROM (SELECT p_partkey, b, replace(lower(b), '-', '_') AS f FROM (SELECT p_partkey, {_BARE} AS b FROM ({_CLASSNAMES})))")
def _(spark, d):
    return ask(spark, d, _CLASSNAMES).select("p_partkey", F.array_join(text.discriminator_classes(F.col("name")), ",").alias("classes"))


_KINDS = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Class' WHEN 1 THEN 'datatype_property' WHEN 2 THEN 'object_property' WHEN 3 THEN 'property' WHEN 4 THEN '' WHEN 5 THEN 'ontology_class' ELSE p_type END AS kind FROM part"


@register(REGISTRY, "prof_kind_admissible", f"SELECT p_partkey, contains(l, 'class') OR l = '' AS class_ok, contains(l, 'data') OR l IN ('property', '') AS data_ok, contains(l, 'object') OR l IN ('property', '') AS object_ok FROM (SELECT p_partkey, lower(kind) AS l FROM ({_KINDS}))")
def _(spark, d):
    return ask(spark, d, _KINDS).select("p_partkey", *[text.kind_allows(F.col("kind"), k).alias(f"{k}_ok") for k in ("class", "data", "object")])


_SEMANTIC = "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'isbn' WHEN 2 THEN 'Code' WHEN 3 THEN 'paper_id' WHEN 4 THEN 'doi' ELSE 'name' END AS col, CASE WHEN p_partkey % 3 = 0 THEN 'papers' ELSE p_type END AS tab, CASE p_partkey % 4 WHEN 0 THEN 'paperId' WHEN 1 THEN 'hasIsbn' WHEN 2 THEN 'car_code' ELSE 'label' END AS target FROM part"


@register(REGISTRY, "val_semantic_id", f"SELECT p_partkey, col <> 'id' AND ((tab = 'papers' AND target = 'paperId') OR (lower(col) IN ('isbn', 'code', 'paper_id', 'doi') AND target IN ('hasIsbn', 'car_code'))) AS allowed FROM ({_SEMANTIC})")
def _(spark, d):
    return ask(spark, d, _SEMANTIC).select("p_partkey", text.semantic_identifier(F.col("tab"), F.col("col"), text.word_set(F.col("target"))).alias("allowed"))


_REQUESTS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 40) || ' Gold answer' WHEN 1 THEN 'the SPARQL Answer ' || source ELSE text END AS request FROM documents"


@register(REGISTRY, "val_request_leaks", f"SELECT doc_id, {' OR '.join(f'''contains(lower(request), '{t}')''' for t in text.LEAKING_TERMS)} AS leaks FROM ({_REQUESTS}) WHERE request IS NOT NULL")
def _(spark, d):
    return ask(spark, d, _REQUESTS).filter("request IS NOT NULL").select("doc_id", text.leaks(F.col("request")).alias("leaks"))


_BODY = "'{\"user\": ' || CAST(user_id AS STRING) || ', \"type\": \"' || event_type || '\"}'"
_ANSWERS = f"SELECT event_id, {_BODY} AS body, CASE event_id % 5 WHEN 0 THEN {_BODY} WHEN 1 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || {_BODY} || ' as asked.' WHEN 3 THEN '[' || {_BODY} || ']' ELSE 'no answer {{' || event_type END AS answer FROM events"


@register(REGISTRY, "val_json_answers", f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN body WHEN event_id % 5 = 3 THEN '[' || body || ']' END AS json FROM ({_ANSWERS})")
def _(spark, d):
    return ask(spark, d, _ANSWERS).select("event_id", text.json_body(F.col("answer")).alias("json"))
