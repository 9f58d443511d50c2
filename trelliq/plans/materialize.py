"""From rules to fact triples, as one lazy plan.

Rules that need nothing but their own row are fused: one scan a table, whatever their number. Rules that ask whether a
referenced row exists become left semi joins on the keys, which Spark broadcasts only below its own size threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text
from ..lineage import spread
from .rules import Rule, numbered

BASE = "urn:trelliq:source:"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def missing(value: Column) -> Column:
    """Null and empty are both no value."""
    return value.isNull() | (value == "")


@dataclass
class _Side:
    """A row that a rule refers to: its table, the local columns with its key, the columns of that key."""

    table: str
    local: tuple[str, ...]
    remote: tuple[str, ...]


class RulePlanner:
    """Plans rules over ``frames``. ``existence`` says what a key is probed against.

    ``primary_key_positional`` compares a rule's key values one by one with the table's key, whatever columns the rule
    names, so reordered or other columns find nothing, or by chance something; ``target_columns`` compares with the
    columns that the rule names.
    """

    def __init__(self, scenario: str, catalog: Catalog, frames: dict[str, DataFrame], rules: list[Rule], existence: str = "primary_key_positional"):
        self.scenario, self.catalog, self.frames, self.existence = scenario, catalog, frames, existence
        self.rules = numbered(rules)
        # of several class rules of a table the last gives the identity
        self.class_ids = {r.source_table: r.id_columns for _, r in self.rules if r.kind == "class" and r.id_columns}

    # --- identities -------------------------------------------------------------------------------------------------

    def iri(self, table: str, row: dict[str, Column], columns: tuple[str, ...]) -> Column:
        """Base, scenario, table and the safe key parts; null parts are left out, and without any the first value stands in."""
        parts = F.concat_ws("_", *[text.safe_fragment(row[c]) for c in columns if c in row])
        spare = [text.safe_fragment(c) for c in row.values()]
        key = F.when(parts == "", F.coalesce(*spare, F.lit("row"))).otherwise(parts)
        return F.concat(F.lit(f"{BASE}{self.scenario}/{table}/"), key)

    def canonical_iri(self, table: str, row: dict[str, Column], columns: tuple[str, ...] = (), seen: tuple[str, ...] = ()) -> Column:
        """The IRI at the end of the identity chain: resolved over the catalog, so no join is needed."""
        here = self.iri(table, row, columns or self.catalog.tables[table].key)
        fk = self.catalog.parent_key(table) if table not in seen else None
        if fk is None or any(c not in row for c in fk.columns):
            return here
        parent = {r: row[c] for c, r in zip(fk.columns, fk.ref_columns, strict=True)}
        lost = reduce(lambda a, b: a | b, [missing(v) for v in parent.values()])
        if fk.ref_table not in self.catalog.tables:
            return F.when(lost, here).otherwise(self.iri(fk.ref_table, parent, fk.ref_columns))
        return F.when(lost, here).otherwise(self.canonical_iri(fk.ref_table, parent, fk.ref_columns, (*seen, table)))

    def _row(self, table: str) -> dict[str, Column]:
        return {c: F.col(c).cast("string") for c in self.frames[table].columns if c in self.catalog.tables[table].names}

    def _own(self, rule: Rule, row: dict[str, Column]) -> Column:
        ids = rule.id_columns if rule.kind == "class" and rule.id_columns else self.class_ids.get(rule.source_table, ())
        return self.canonical_iri(rule.source_table, row, ids or self.catalog.tables[rule.source_table].key)

    # --- what a rule needs ------------------------------------------------------------------------------------------

    def _sides(self, rule: Rule) -> list[tuple[str, _Side]]:
        key = lambda t, given: given or self.catalog.tables[t].key
        if rule.kind == "data" and rule.subject_table:
            return [("subject", _Side(rule.subject_table, rule.subject_columns, key(rule.subject_table, rule.subject_target_columns)))]
        if rule.kind == "object" and rule.subject_table and rule.object_table:
            return [
                ("subject", _Side(rule.subject_table, rule.subject_columns, key(rule.subject_table, rule.subject_target_columns))),
                ("object", _Side(rule.object_table, rule.object_columns, key(rule.object_table, rule.object_target_columns))),
            ]
        if rule.kind == "object":
            return [("target", _Side(rule.target_table, rule.source_columns, key(rule.target_table, rule.target_columns)))]
        return []

    def _filter(self, rule: Rule, row: dict[str, Column]) -> Column:
        f = rule.row_filter
        if f is None or (not f.truthy and f.equals is None):
            return F.lit(True)
        value = row.get(f.column, F.lit(None).cast("string"))
        return text.truthy(value) if f.truthy else text.equals(value, f.equals)

    def _lost(self, side: _Side, row: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a | b, [missing(row[c]) for c in side.local[: len(side.remote)]], F.lit(False))

    def _triple(self, rule: Rule, row: dict[str, Column]) -> tuple[Column, Column, Column]:
        """(subject, object, whether the object is a literal)."""
        sides = dict(self._sides(rule))
        far = lambda s: self.canonical_iri(s.table, {r: row[c] for c, r in zip(s.local, s.remote, strict=False)}, s.remote)
        subject = far(sides["subject"]) if "subject" in sides else self._own(rule, row)
        if rule.kind == "class":
            return subject, F.lit(rule.target), F.lit(False)
        if rule.kind == "data":
            return subject, text.unescape(row[rule.source_column]), F.lit(True)
        return subject, far(sides.get("object") or sides["target"]), F.lit(False)

    def _keys(self, side: _Side, tag: str) -> DataFrame | None:
        """The keys that exist, named as local columns are matched; None if none can match."""
        meta = self.catalog.tables.get(side.table)
        if meta is None or side.table not in self.frames:
            return None
        columns = meta.key if self.existence == "primary_key_positional" else side.remote
        if len(columns) != len(side.remote):
            return None
        return self.frames[side.table].select(*[F.col(c).cast("string").alias(f"_{tag}{i}") for i, c in enumerate(columns)])

    def _predicate(self, rule: Rule) -> str:
        return TYPE if rule.kind == "class" else rule.target

    # --- plans ------------------------------------------------------------------------------------------------------

    def triples(self, kinds: tuple[str, ...] = ("class", "data", "object")) -> DataFrame:
        """All facts with repetitions: (s, p, o, is_literal)."""
        return self._planned([r for _, r in self.rules if r.kind in kinds])

    def graph(self, predicate: str | None = None, class_: str | None = None) -> DataFrame:
        """Facts as a set; with ``predicate`` those of it, planned from the rules that can give them (``class_``: of instances of it)."""
        chosen = [r for _, r in self.rules if predicate is None or self._predicate(r) == predicate and (predicate != TYPE or class_ is None or r.target == class_)]
        return self._planned(chosen).dropDuplicates(["s", "p", "o", "is_literal"])

    def _planned(self, chosen: list[Rule]) -> DataFrame:
        plans = []
        for table in dict.fromkeys(r.source_table for r in chosen):
            local = [r for r in chosen if r.source_table == table and not self._sides(r)]
            if local:
                plans.append(self._fused(table, local))
        plans += [self._probed(r) for r in chosen if self._sides(r)]
        if not plans:
            spark = next(iter(self.frames.values())).sparkSession
            return spark.createDataFrame([], "s string, p string, o string, is_literal boolean")
        return reduce(DataFrame.unionByName, plans)

    def _fused(self, table: str, rules: list[Rule]) -> DataFrame:
        row = self._row(table)
        made = []
        for r in rules:
            s, o, literal = self._triple(r, row)
            good = self._filter(r, row) if r.kind == "class" else ~missing(row[r.source_column])
            made.append(F.when(good, F.struct(s.alias("s"), F.lit(self._predicate(r)).alias("p"), o.alias("o"), literal.alias("is_literal"))))
        if len(made) == 1:
            return self.frames[table].select(made[0].alias("t")).filter("t is not null").select("t.*")
        return text.each(spread(self.frames[table]).select(F.array(*made).alias("_all")), "_all", "t").select("t.*")

    def _probed(self, rule: Rule) -> DataFrame:
        row = self._row(rule.source_table)
        sides = self._sides(rule)
        s, o, literal = self._triple(rule, row)
        good = reduce(lambda a, b: a & b, [~self._lost(x, row) for _, x in sides])
        if rule.kind == "data":
            good &= ~missing(row[rule.source_column])
        probes = [row[c].alias(f"_probe_{tag}{i}") for tag, x in sides for i, c in enumerate(x.local[: len(x.remote)])]
        out = spread(self.frames[rule.source_table]).filter(good).select(s.alias("s"), F.lit(self._predicate(rule)).alias("p"), o.alias("o"), literal.alias("is_literal"), *probes)
        for tag, x in sides:
            keys = self._keys(x, tag)
            if keys is None or not x.local:
                return out.select("s", "p", "o", "is_literal").limit(0)
            on = reduce(lambda a, b: a & b, [F.col(f"_probe_{tag}{i}") == F.col(f"_{tag}{i}") for i in range(len(x.remote))])
            out = out.join(keys, on, "left_semi")
        return out.select("s", "p", "o", "is_literal")

    def attempts(self) -> DataFrame:
        """A row for each rule and row of its table: rule_id, reason of failure (null if a fact came out)."""
        return reduce(DataFrame.unionByName, [self._attempt(i, r) for i, r in self.rules])

    def _attempt(self, rule_id: str, rule: Rule, with_key: bool = False) -> DataFrame:
        row = self._row(rule.source_table)
        sides = self._sides(rule)
        out = self.frames[rule.source_table]
        steps: list[tuple[Column, str]] = []
        if rule.kind == "class":
            steps.append((~self._filter(rule, row), "row_filter_rejected"))
        if rule.kind == "data":
            steps.append((missing(row[rule.source_column]), "empty_source_value"))
        if rule.kind == "object" and sides[0][0] == "target" and not rule.source_columns:
            steps.append((F.lit(True), "missing_source_columns"))
        steps += [(self._lost(x, row), f"missing_{tag}_key") for tag, x in sides]
        for tag, x in sides:
            keys = self._keys(x, tag)
            if keys is None or not x.local:
                steps.append((F.lit(True), f"missing_{tag}_row"))
                continue
            on = reduce(lambda a, b: a & b, [row[c] == F.col(f"_{tag}{i}") for i, c in enumerate(x.local)])
            out = out.join(keys.distinct().withColumn(f"_hit_{tag}", F.lit(True)), on, "left")
            steps.append((F.col(f"_hit_{tag}").isNull(), f"missing_{tag}_row"))
        reason = F.lit(None).cast("string")
        for test, name in reversed(steps):
            reason = F.when(test, name).otherwise(reason)
        key = [F.concat_ws("_", *[row[c] for c in self.catalog.tables[rule.source_table].key if c in row]).alias("key")] if with_key else []
        return out.select(F.lit(rule_id).alias("rule_id"), reason.alias("reason"), *key)

    def rule_summary(self, samples: int = 3) -> DataFrame:
        """Per rule: kind, reachable rows (of its table), helper calls, emitted facts, failures by reason and the first rows that failed.

        Every row of a rule's table is tried, so calls are as many as rows. Samples are the smallest failing rows by key,
        ranked before they are gathered.
        """
        kinds = F.create_map(*[F.lit(x) for i, r in self.rules for x in (i, r.kind)])
        keyed = reduce(DataFrame.unionByName, [self._attempt(i, r, with_key=True) for i, r in self.rules])
        counts = keyed.groupBy("rule_id", "reason").agg(F.count("*").alias("n"))
        per = counts.groupBy("rule_id").agg(
            F.sum("n").alias("reachable_rows"), F.sum("n").alias("helper_calls"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("emitted"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ",").alias("failures"),
        )
        failed = keyed.filter("reason IS NOT NULL").withColumn("_i", F.row_number().over(Window.partitionBy("rule_id").orderBy("key", "reason"))).filter(F.col("_i") <= samples)
        first = failed.groupBy("rule_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "key"))), lambda x: x["key"]), ",").alias("samples"))
        return per.join(first, "rule_id", "left").select("rule_id", kinds[F.col("rule_id")].alias("kind"), "reachable_rows", "helper_calls", "emitted", "failures", F.coalesce("samples", F.lit("")).alias("samples"))

    def stats(self) -> DataFrame:
        """Per rule and outcome: how many rows were tried and how many gave a fact or failed for the reason first met."""
        return self.attempts().groupBy("rule_id", F.coalesce("reason", F.lit("emitted")).alias("outcome")).agg(F.count("*").alias("n"))


def n_triples(triples: DataFrame) -> DataFrame:
    """One line of N-Triples each."""
    o = F.when(F.col("is_literal"), F.concat(F.lit('"'), text.escape(F.col("o")), F.lit('"'))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("line"))


def invalid_triples(triples: DataFrame) -> DataFrame:
    """A row for each reason why a triple is none: subject, predicate or a non-literal object without http, https or urn."""
    uri = lambda c: F.coalesce(F.col(c).rlike("^(http://|https://|urn:)"), F.lit(False))
    reasons = F.array(
        F.when(~uri("s"), "invalid_subject"),
        F.when(~uri("p"), "invalid_predicate"),
        F.when(~F.col("is_literal") & ~uri("o"), "invalid_object"),
    )
    return triples.select("s", "p", "o", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def mapping_document(catalog: Catalog, namespace: str = "urn:trelliq:direct:") -> str:
    """The direct mapping as a mapping document: a class for each table, a property for each column and key."""
    out = ["@prefix rr: <http://www.w3.org/ns/r2rml#> .", ""]
    for t in catalog.tables.values():
        key = "/".join(f"{c}={{{c}}}" for c in t.key)
        parts = [f'rr:logicalTable [ rr:tableName "{t.name}" ]', f'rr:subjectMap [ rr:template "{namespace}{t.name}/{key}" ; rr:class <{namespace}{t.name}> ]']
        parts += [f'rr:predicateObjectMap [ rr:predicate <{namespace}{t.name}#{c}> ; rr:objectMap [ rr:column "{c}" ] ]' for c in t.names]
        for fk in t.foreign_keys:
            to = "/".join(f"{r}={{{c}}}" for c, r in zip(fk.columns, fk.ref_columns, strict=True))
            parts.append(f'rr:predicateObjectMap [ rr:predicate <{namespace}{t.name}#ref-{"_".join(fk.columns)}> ; rr:objectMap [ rr:template "{namespace}{fk.ref_table}/{to}" ; rr:termType rr:IRI ] ]')
        out += [f"<{namespace}map/{t.name}> a rr:TriplesMap ;", "    " + " ;\n    ".join(parts) + " .", ""]
    return "\n".join(out)


def direct_mapping(catalog: Catalog, frames: dict[str, DataFrame], namespace: str = "urn:trelliq:direct:") -> DataFrame:
    """Rows as facts without rules: a type, a literal for each value, a link for each single-column key (first column only)."""
    plans = []
    for name, meta in catalog.tables.items():
        if name not in frames:
            continue
        key = F.col(meta.key[0]).cast("string")
        s = F.concat(F.lit(f"{namespace}{name}/"), text.safe_fragment(key))
        made = [F.struct(F.lit(TYPE).alias("p"), F.lit(f"{namespace}{name}").alias("o"), F.lit(False).alias("is_literal"))]
        for c in meta.names:
            if c in frames[name].columns:
                v = F.col(c).cast("string")
                made.append(F.when(~missing(v), F.struct(F.lit(f"{namespace}{name}#{c}").alias("p"), v.alias("o"), F.lit(True).alias("is_literal"))))
        for fk in meta.foreign_keys:
            v = F.col(fk.columns[0]).cast("string")
            made.append(F.when(~missing(v), F.struct(F.lit(f"{namespace}{name}#ref-{fk.columns[0]}").alias("p"), F.concat(F.lit(f"{namespace}{fk.ref_table}/"), text.safe_fragment(v)).alias("o"), F.lit(False).alias("is_literal"))))
        plans.append(frames[name].select(s.alias("s"), F.explode(F.filter(F.array(*made), lambda t: t.isNotNull())).alias("t")).select("s", "t.*"))
    return reduce(DataFrame.unionByName, plans)


def graph_counts(triples: DataFrame) -> DataFrame:
    """Facts of each IRI as class and as predicate (rdf:type counts as a predicate as well), with distinct subjects and objects."""
    typed = triples.filter((F.col("p") == TYPE) & ~F.col("is_literal")).select(F.col("o").alias("iri"), F.lit("class").alias("role"), "s", F.lit(None).cast("string").alias("v"))
    used = triples.select(F.col("p").alias("iri"), F.lit("predicate").alias("role"), "s", F.col("o").alias("v"))
    return typed.unionByName(used).groupBy("iri", "role").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("v").alias("objects"))


def evidence(facts: DataFrame, most: int = 5) -> DataFrame:
    """(iri, n, samples): instances of each class, facts of each predicate, and a predicate's first values in order, for the texts of records.

    Values are ranked before they are gathered, so no predicate's values are held whole.
    """
    classes = facts.filter((F.col("p") == TYPE) & ~F.col("is_literal")).groupBy(F.col("o").alias("iri")).agg(F.count_distinct("s").alias("n")).withColumn("samples", F.lit(""))
    rest = facts.filter(F.col("p") != TYPE)
    first = rest.select("p", "o").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy("o"))).filter(F.col("_r") <= most)
    samples = first.groupBy("p").agg(F.array_join(F.sort_array(F.collect_list("o")), ", ").alias("samples"))
    return classes.unionByName(rest.groupBy("p").agg(F.count("*").alias("n")).join(samples, "p").select(F.col("p").alias("iri"), "n", "samples"))
