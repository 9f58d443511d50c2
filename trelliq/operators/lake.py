"""Schemas as tables: roles, edges, components and mapping patterns of as many tables as a data lake holds.

``columns`` has a row a column: table_name, position, column_name, datatype, is_pk. ``keys`` has a row a column of each
foreign key: child, key_id, column_name, parent, ref_column. Everything is an aggregate or an equi join on the table's
name; nothing is gathered but a table's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def with_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """The columns with ``is_fk``."""
    held = keys.select(F.col("child").alias("table_name"), "column_name").distinct().withColumn("is_fk", F.lit(True))
    return columns.join(held, ["table_name", "column_name"], "left").withColumn("is_fk", F.coalesce("is_fk", F.lit(False)))


def key_lists(keys: DataFrame) -> DataFrame:
    """(child, key_id, parent, key, ref): a foreign key's columns and what they refer to, in the order of their names."""
    return keys.groupBy("child", "key_id", "parent").agg(F.sort_array(F.collect_list(F.struct("column_name", "ref_column"))).alias("k")).select("child", "key_id", "parent", F.col("k.column_name").alias("key"), F.col("k.ref_column").alias("ref"))


def primary_keys(columns: DataFrame) -> DataFrame:
    """(table_name, pk, first): primary-key columns by name, empty without one, and the first column."""
    pk = F.sort_array(F.collect_list(F.when(F.col("is_pk"), F.col("column_name"))))
    return columns.groupBy("table_name").agg(pk.alias("pk"), F.min_by("column_name", "position").alias("first"))


def discriminator(name: Column, datatype: Column) -> Column:
    """A column that names a row's class: is_..., type, or of a boolean type."""
    return F.lower(name).startswith("is_") | (F.lower(name) == "type") | F.contains(F.lower(datatype), F.lit("bool"))


def table_roles(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, role, join_like) by four ordered tests on counts of a table's columns."""
    c = with_keys(columns, keys)
    pk, fk = F.col("is_pk"), F.col("is_fk")
    per = c.groupBy("table_name").agg(F.count("*").alias("n"), F.count_if(pk).alias("p"), F.count_if(fk).alias("f"), F.count_if(pk & fk).alias("both"), F.count_if(~pk & ~fk).alias("plain"))
    count = keys.groupBy("child").agg(F.count_distinct("key_id").alias("k")).withColumnRenamed("child", "table_name")
    per = per.join(count, "table_name", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    role = F.when(F.expr("p > 1 AND p = n"), "join_table").when(F.expr("p > 0 AND both = p"), "subtype_table").when(F.expr("k > 1 AND plain = 0 AND n <= f + 1"), "join_table").otherwise("entity_table")
    return per.select("table_name", role.alias("role"), F.expr("k > 0 AND f = n").alias("join_like"))


def column_roles(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, column_name, column_role, discriminator, generic_identifier)."""
    low = F.lower("column_name")
    generic = F.col("is_fk") | (low == "id") | (F.col("is_pk") & low.endswith("_id"))
    role = F.when(F.col("is_pk"), "primary_key").when(F.col("is_fk"), "foreign_key").when(low == "id", "generic_identifier").otherwise("attribute")
    return with_keys(columns, keys).select("table_name", "column_name", role.alias("column_role"), discriminator(F.col("column_name"), F.col("datatype")).alias("discriminator"), generic.alias("generic_identifier"))


def parent_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(child, key_id, parent, key): the first foreign key whose columns are the primary key: rows of both tables are the same things."""
    same = key_lists(keys).join(primary_keys(columns).filter(F.size("pk") > 0), (F.col("child") == F.col("table_name")) & (F.col("key") == F.col("pk")))
    return same.groupBy("child").agg(F.min(F.struct("key_id", "parent", "key")).alias("k")).select("child", "k.*")


def edges(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(kind, source, target) of the schema graph: five kinds; a column is table.column."""
    dotted = lambda t, c: F.concat(F.col(t), F.lit("."), F.col(c))
    own = dotted("table_name", "column_name")
    cols = columns.select(F.explode(F.filter(F.array(F.lit("contains_column"), F.when(F.col("is_pk"), "primary_key")), lambda k: k.isNotNull())).alias("kind"), F.col("table_name").alias("source"), own.alias("target"))
    to = keys.select(F.lit("foreign_key").alias("kind"), dotted("child", "column_name").alias("source"), dotted("parent", "ref_column").alias("target"))
    back = keys.select("child", "key_id", "parent").distinct().select(F.lit("reverse_foreign_key").alias("kind"), F.col("parent").alias("source"), F.col("child").alias("target"))
    same = parent_keys(columns, keys).select(F.lit("primary_key_as_foreign_key").alias("kind"), F.col("child").alias("source"), F.col("parent").alias("target"))
    return cols.unionByName(to).unionByName(back).unionByName(same)


def components(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(component, table_name) of the undirected graph of known tables; a component is named by its smallest table.

    Labels sink to the smallest neighbour's and to that one's own label, a number of rounds logarithmic in the longest
    chain, mostly; each round is cut off from the plan before it.
    """
    tables = columns.select("table_name").distinct()
    known = keys.select(F.col("child").alias("a"), F.col("parent").alias("b")).filter("a <> b").distinct()
    known = known.join(tables.select(F.col("table_name").alias("a")), "a", "left_semi").join(tables.select(F.col("table_name").alias("b")), "b", "left_semi")
    both = cut(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(tables.select("table_name", F.col("table_name").alias("component")))
    while True:
        near = both.join(label, F.col("b") == F.col("table_name")).groupBy("a").agg(F.min("component").alias("m"))
        sunk = label.join(near, F.col("table_name") == F.col("a"), "left").select("table_name", "component", F.least("component", "m").alias("m"))
        jump = label.select(F.col("table_name").alias("_t"), F.col("component").alias("_c"))
        new = cut(sunk.join(jump, F.col("m") == F.col("_t")).select("table_name", F.least("m", "_c").alias("new"), "component"))
        if new.filter("new <> component").isEmpty():
            return label.select("component", "table_name")
        label = new.select("table_name", F.col("new").alias("component"))


def neighbours(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """The tables and those that their keys refer to: one hop."""
    return tables.select("table_name").unionByName(tables.join(keys, F.col("table_name") == F.col("child")).select(F.col("parent").alias("table_name"))).distinct()


# The scores of patterns by type (WEAK_ENTITY is declared and never found).
SCORES = {"SUBCLASS_PKFK": 0.95, "SCHEMA_ENTITY": 0.9, "IDENTIFIER_AS_URI": 0.88, "JOIN_TABLE_OBJECT": 0.85, "FK_OBJECT": 0.8, "ASSOCIATION_ENTITY": 0.75, "LITERAL_ATTRIBUTE": 0.7}


def patterns(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(pattern_type, table_name, columns, score) that a schema shows: classes, attributes, links and associations."""
    comma = lambda c: F.array_join(F.sort_array(c), ",")
    lists = key_lists(keys)
    fks = with_keys(columns, keys).filter("is_fk").groupBy("table_name").agg(comma(F.collect_list("column_name")).alias("fks"))
    count = lists.groupBy(F.col("child").alias("table_name")).agg(F.count("*").alias("k"))
    parent = parent_keys(columns, keys).select(F.col("child").alias("table_name"), F.col("key_id").alias("pkey"))
    t = table_roles(columns, keys).join(primary_keys(columns), "table_name").join(fks, "table_name", "left").join(count, "table_name", "left").join(parent, "table_name", "left")
    pk = comma(F.col("pk"))
    joins, subtype = F.col("role") == "join_table", F.col("pkey").isNotNull()
    kind = F.when(joins, "JOIN_TABLE_OBJECT").when(subtype, "SUBCLASS_PKFK").when(F.col("k") > 1, "ASSOCIATION_ENTITY").otherwise("SCHEMA_ENTITY")
    said = F.when(joins | (~subtype & (F.col("k") > 1)), F.col("fks")).otherwise(F.when(pk == "", F.col("first")).otherwise(pk))
    found = t.select(kind.alias("pattern_type"), "table_name", said.alias("columns"))
    found = found.unionByName(t.filter((pk != "") & ~subtype & ~joins).select(F.lit("IDENTIFIER_AS_URI").alias("pattern_type"), "table_name", pk.alias("columns")))
    plain = t.filter(~joins).select("table_name", "pkey")
    links = lists.join(plain, F.col("child") == F.col("table_name")).filter(F.col("pkey").isNull() | (F.col("pkey") != F.col("key_id")))
    found = found.unionByName(links.select(F.lit("FK_OBJECT").alias("pattern_type"), "table_name", F.array_join("key", ",").alias("columns")))
    literal = with_keys(columns, keys).filter(~F.col("is_pk") & ~F.col("is_fk") & ~discriminator(F.col("column_name"), F.col("datatype"))).join(plain, "table_name", "left_semi")
    found = found.unionByName(literal.select(F.lit("LITERAL_ATTRIBUTE").alias("pattern_type"), "table_name", F.col("column_name").alias("columns")))
    score = F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair])
    return found.withColumn("score", score[F.col("pattern_type")])


def best_patterns(found: DataFrame, most: int) -> DataFrame:
    """Each table's ``most`` best patterns: by score, then by type and columns."""
    w = Window.partitionBy("table_name").orderBy(F.desc("score"), "pattern_type", "columns")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


# --- patterns to rules ---------------------------------------------------------------------------------------------

# Pattern types by the kind of rule that they give.
CLASS_TYPES = ("SCHEMA_ENTITY", "SUBCLASS_PKFK", "WEAK_ENTITY")
OBJECT_TYPES = ("FK_OBJECT", "JOIN_TABLE_OBJECT", "ASSOCIATION_ENTITY")


def compile_patterns(selected: DataFrame, columns: DataFrame, keys: DataFrame, templates: DataFrame, complete_types: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rules, rejected) of selected patterns.

    selected: pattern_id, position, pattern_type, target, source_id, score, target_id_like, source_table, source_column,
    source_columns (array), target_table, id_columns (array), subject_table, object_table. templates: table_name,
    id_columns, the columns that URIs of a table are made of. A rejected pattern has one reason, the first that holds.
    Equal rules are one, the first stays. With ``complete_types`` an object rule also gives class rules for the tables
    at its ends, of the classes that patterns before it gave them.
    """
    names = columns.groupBy("table_name").agg(F.collect_set("column_name").alias("_names"), F.min_by("column_name", "position").alias("_first"), F.sort_array(F.collect_list(F.when(F.col("is_pk"), F.col("column_name")))).alias("_pk"))
    fks = with_keys(columns, keys).filter("is_fk").groupBy("table_name").agg(F.collect_set("column_name").alias("_fks"))
    here = names.join(fks, "table_name", "left").withColumnRenamed("table_name", "source_table").withColumn("_here", F.lit(True))
    there = names.select(F.col("table_name").alias("target_table"), F.lit(True).alias("_there"))
    own = templates.select(F.col("table_name").alias("source_table"), F.col("id_columns").alias("_template"))
    p = selected.filter("pattern_type <> 'IDENTIFIER_AS_URI'").join(here, "source_table", "left").join(there, "target_table", "left").join(own, "source_table", "left")
    table_key = F.when(F.size("_pk") > 0, F.col("_pk")).otherwise(F.array("_first"))
    p = p.withColumn("_ids", F.coalesce("_template", F.when(F.size("id_columns") > 0, F.col("id_columns")), table_key))
    is_class, is_object, is_literal = F.col("pattern_type").isin(*CLASS_TYPES), F.col("pattern_type").isin(*OBJECT_TYPES), F.col("pattern_type") == "LITERAL_ATTRIBUTE"
    unknown = lambda c: F.size(F.array_except(c, "_names")) > 0
    reason = (
        F.when(F.col("target").isNull() | (F.col("target") == ""), "target_not_selected").when(F.col("_here").isNull(), "unknown_source_table").when(is_class & unknown("_ids"), "unknown_id_column")
        .when(is_literal & ~F.coalesce(F.array_contains("_names", F.col("source_column")), F.lit(False)), "unknown_source_column")
        .when(is_literal & F.coalesce(F.array_contains("_fks", F.col("source_column")), F.lit(False)) & ~F.col("target_id_like"), "fk_like_literal_rejected")
        .when(is_object & F.col("_there").isNull(), "unknown_target_table").when(is_object & unknown("source_columns"), "unknown_source_columns")
        .when(~is_class & ~is_object & ~is_literal, "unsupported_pattern_type")
    )
    p = p.withColumn("reason", reason)
    rejected = p.filter("reason IS NOT NULL").select("pattern_id", "reason")
    good = p.filter("reason IS NULL")
    kind = F.when(is_class, "class").when(is_literal, "data").otherwise("object")
    key = F.when(is_class, F.array_join("_ids", ",")).when(is_literal, F.col("source_column")).otherwise(F.array_join("source_columns", ","))
    made = good.select(kind.alias("kind"), "source_table", "target", key.alias("columns"), F.when(is_object, F.col("target_table")).alias("target_table"), "pattern_id", F.col("score").alias("confidence"), F.lit(None).cast("string").alias("inferred_from"), "position")
    if complete_types:
        ends = good.filter(is_object).select("position", F.explode(F.array(F.coalesce("subject_table", "source_table"), F.coalesce("object_table", "target_table"))).alias("source_table"))
        ids = templates.select(F.col("table_name").alias("source_table"), F.array_join("id_columns", ",").alias("columns"))
        classes = made.filter("kind = 'class'").groupBy("source_table", "target").agg(F.min("position").alias("_since"))
        typed = ends.join(ids, "source_table").join(classes, "source_table").filter(F.col("_since") < F.col("position"))
        typed = typed.select(F.lit("class").alias("kind"), "source_table", "target", "columns", F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("pattern_id"), F.lit(0.5).alias("confidence"), F.lit("safe_domain_range_type_completion").alias("inferred_from"), "position")
        made = made.unionByName(typed)
    rule = ["kind", "source_table", "target", "columns", "target_table", "pattern_id", "confidence", "inferred_from"]
    return made.groupBy(*rule).agg(F.min("position").alias("position")), rejected


def discriminators(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """(source_id, table_name, column_name, truthy, equals): class discriminators that the values of (table_name, column_name, value) bear out.

    A boolean column needs a truthy value, or a table without rows; a type column gives one for each of its two to eight
    values.
    """
    from ..functions.text import truthy

    low = F.lower("column_name")
    typed, boolean = low == "type", low.startswith("is_") | F.contains(F.lower("datatype"), F.lit("bool"))
    some = columns.filter(typed | boolean).select("table_name", "column_name", typed.alias("_typed"), boolean.alias("_boolean"))
    c = cells.join(F.broadcast(some) if some.count() <= 100_000 else some, ["table_name", "column_name"]).select("table_name", "column_name", F.nullif(F.col("value").cast("string"), F.lit("")).alias("value"))
    per = c.groupBy("table_name", "column_name", "value").agg(F.lit(1).alias("n")).groupBy("table_name", "column_name").agg(F.count("value").alias("_values"), F.max(truthy(F.col("value")).cast("int")).alias("_true"))
    j = some.join(per, ["table_name", "column_name"], "left")
    name = F.concat(F.lit("source-discriminator:"), "table_name", F.lit("."), "column_name")
    yes = j.filter(F.col("_boolean") & F.coalesce(F.col("_true") == 1, F.lit(True))).select(name.alias("source_id"), "table_name", "column_name", F.lit(True).alias("truthy"), F.lit(None).cast("string").alias("equals"))
    few = j.filter(F.col("_typed") & ~F.col("_boolean") & F.col("_values").between(2, 8)).select("table_name", "column_name")
    values = c.join(few, ["table_name", "column_name"]).filter("value IS NOT NULL").distinct()
    return yes.unionByName(values.select(F.concat(name, F.lit(":"), "value").alias("source_id"), "table_name", "column_name", F.lit(False).alias("truthy"), F.col("value").alias("equals")))


def uri_templates(columns: DataFrame, keys: DataFrame, profiles: DataFrame, scenario: str, base: str) -> DataFrame:
    """(table_name, id_columns, reason, uri_template): what URIs of each table's rows are made of.

    The primary key, else the unique column without nulls that looks most like an identifier (the first of equal ones),
    else the table's key. A table whose key refers to another's rows shares their identity. profiles: table_name,
    column_name, null_rate, distinct_ratio, identifier_likeness.
    """
    unique = columns.select("table_name", "column_name", "position").join(profiles, ["table_name", "column_name"]).filter("null_rate = 0 AND distinct_ratio >= 0.98")
    best = unique.groupBy("table_name").agg(F.max(F.struct("identifier_likeness", (-F.col("position")).alias("p"), "column_name")).alias("u"))
    pk = columns.groupBy("table_name").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_pk"), F.struct("position", "column_name")))), lambda x: x["column_name"]).alias("pk"), F.min_by("column_name", "position").alias("first"))
    parent = parent_keys(columns, keys).select(F.col("child").alias("table_name"), F.lit(True).alias("_shared"))
    t = pk.join(best, "table_name", "left").join(parent, "table_name", "left")
    has_key = F.size("pk") > 0
    ids = F.when(has_key, F.col("pk")).when(F.col("u").isNotNull(), F.array("u.column_name")).otherwise(F.array("first"))
    reason = F.when(F.coalesce("_shared", F.lit(False)), "subclass_pkfk_parent_identity").when(has_key, "primary_key").when(F.col("u").isNotNull(), "unique_non_null_profile").otherwise("fallback_table_key")
    template = F.concat(F.lit(f"{base}{scenario}/"), "table_name", F.lit("/"), F.array_join(F.transform(ids, lambda c: F.concat(F.lit("{"), c, F.lit("}"))), "_"))
    return t.select("table_name", F.array_join(ids, ",").alias("id_columns"), reason.alias("reason"), template.alias("uri_template"))
