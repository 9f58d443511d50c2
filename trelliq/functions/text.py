"""Text functions as column expressions: everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a truthy row filter takes (trimmed, lower-cased), abbreviations, and nouns for persons.
TRUTHY = ("1", "t", "true", "yes", "y")
SPELT_OUT = {"conf": ("conference",), "pc": ("program", "committee")}
PERSONS = {"chairman": "chair", "people": "person"}


def each(df: DataFrame, array: str, name: str) -> DataFrame:
    """A row for each element of an array, none for an empty one.

    An outer explode and a test behind it: of a plain one Spark makes a filter on the array's size before it, for which a
    costly array is made twice.
    """
    return df.withColumn(name, F.explode_outer(array)).drop(array).filter(F.col(name).isNotNull())


def tokens(text: Column) -> Column:
    """Lower-cased words: ``_`` and ``-`` are spaces, camel case is split, everything but letters, digits and ``_`` separates."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[_\-]+", " "), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def word_set(text: Column) -> Column:
    """Distinct tokens with their expansions: two abbreviations spelt out, singular forms beside plurals, two person nouns."""
    base = tokens(text)

    def expand(w: Column) -> Column:
        none = F.array().cast("array<string>")
        spelt = none
        for short, full in SPELT_OUT.items():
            spelt = F.when(w == short, F.array(*map(F.lit, full))).otherwise(spelt)
        ies = F.when(w.endswith("ies"), F.array(F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y")))).otherwise(none)
        plural = F.when(w.endswith("s") & (F.length(w) > 3), F.array(F.substr(w, F.lit(1), F.length(w) - 1))).otherwise(none)
        return F.concat(F.array(w), spelt, ies, plural)

    grown = F.flatten(F.transform(base, expand))
    none = F.array().cast("array<string>")
    more = [F.when(F.array_contains(grown, a), F.array(F.lit(b))).otherwise(none) for a, b in PERSONS.items()]
    return F.array_distinct(F.concat(grown, *more))


def lexical_bonus(source: Column, candidate: Column) -> Column:
    """0.35 for each shared word and for two more if one set holds the other, at most 1; 0 if either is empty."""
    both = F.size(F.array_intersect(source, candidate))
    holds = (both == F.size(source)) | (both == F.size(candidate))
    empty = (F.size(source) == 0) | (F.size(candidate) == 0)
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), (both + F.when(holds, 2).otherwise(0)) * 0.35))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts, 0 if one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def safe_fragment(value: Column) -> Column:
    """Runs of other characters than letters, digits and ``_`` become ``_``; none at the ends; ``id`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(value.cast("string"), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(kept == "", F.lit("id")).otherwise(kept)


def unescape(value: Column) -> Column:
    r"""\n, \r, \t and \\ become the characters they stand for, in this order."""
    for mark, char in ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\\", "\\")):
        value = F.replace(value, F.lit(mark), F.lit(char))
    return value


def escape(value: Column) -> Column:
    r"""A literal's text for N-Triples."""
    for char, mark in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        value = F.replace(value, F.lit(char), F.lit(mark))
    return value


def local_name(uri: Column) -> Column:
    """What follows ``#``, else the last ``/``."""
    bare = F.regexp_replace(uri, "/+$", "")
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(bare, "/", -1))


def namespace(uri: Column) -> Column:
    """What stands before the local name, its separator included."""
    hash_ = F.concat(F.substring_index(uri, "#", 1), F.lit("#"))
    return F.when(F.contains(uri, F.lit("#")), hash_).otherwise(F.regexp_replace(uri, "[^/]*$", ""))


def normalize_uri(text: Column, prefixes: dict[str, str]) -> Column:
    """A URI without its brackets or wrapper, with a known prefix spelt out (not where a scheme with ``://`` stands)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = F.when(t.startswith("<") & t.endswith(">"), F.trim(F.regexp_extract(t, "^<(.*)>$", 1))).otherwise(t)
    t = F.when(t.startswith("URIRef(") & t.endswith(")"), F.regexp_replace(F.regexp_extract(t, r"^URIRef\((.*)\)$", 1), "^[ '\"]+|[ '\"]+$", "")).otherwise(t)
    scheme = t.rlike("(?i)^[a-z][a-z0-9+.-]*://")
    out = t
    for prefix, full in prefixes.items():
        out = F.when(~scheme & t.startswith(prefix + ":"), F.concat(F.lit(full), F.substr(t, F.lit(len(prefix) + 2)))).otherwise(out)
    return out


def compact(text: Column, most: int) -> Column:
    """White space made single; a longer text is cut and ends in three dots."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substr(flat, F.lit(1), F.lit(max(0, most - 3)))), F.lit("...")))


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("None")))).isin(*TRUTHY)


def equals(value: Column, wanted: str) -> Column:
    """Trimmed, lower-cased equality; a null reads ``none``."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("None")))) == wanted.strip().lower()


def identifier_like(value: Column) -> Column:
    """Short codes and numbers with a letter at most at each end."""
    t = F.trim(value)
    return F.coalesce(t.rlike("^[A-Za-z0-9_-]{1,12}$") | t.rlike("^[A-Za-z]?[0-9]+[A-Za-z]?$"), F.lit(False))


def stable_integer(parts: list[Column]) -> Column:
    """The first 48 bits of SHA-256 over the parts joined by ``|`` (nulls are empty)."""
    raw = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substr(F.sha2(raw, 256), F.lit(1), F.lit(12)), 16, 10).cast("long")


def stable_keep(seed: str, table: str, key: list[Column], fraction: float) -> Column:
    return stable_integer([F.lit(seed), F.lit(table), *key]) / F.lit(float((1 << 48) - 1)) < fraction


# Columns that name things, words of targets that such columns may go to, names of discriminator classes,
# and words that a request must not hold.
SEMANTIC_IDS = ("abbrev", "abbreviation", "code", "doi", "email", "isbn", "issn", "paper_id", "paperid", "url")
SEMANTIC_TARGETS = ("abbrev", "abbreviation", "car", "code", "doi", "email", "isbn", "issn", "url")
CLASS_ALIASES = {"author_paper_student": "Author_of_paper_student", "program_committee_member": "Program_Committee_member"}
LEAKING_TERMS = ("expected triple", "false negative", "false positive", "gold", "llm4vkg", "paper score", "qpair", "sparql answer", "sql answer")


def semantic_identifier(table: Column, column: Column, target_words: Column) -> Column:
    """Whether an identifier column may be a literal after all: never ``id``; paper ids for such targets; codes, links and the like."""
    low, joined = F.lower(column), F.array_join(target_words, "")
    paper = F.array_contains(word_set(table), "paper") & F.contains(joined, F.lit("paper")) & F.contains(joined, F.lit("id"))
    named = low.isin(*SEMANTIC_IDS) & F.arrays_overlap(target_words, F.array(*map(F.lit, SEMANTIC_TARGETS)))
    return (low != "id") & (paper | named)


def title_case(name: Column) -> Column:
    """Words between ``_`` and ``-``, each with a capital first letter, joined by ``_``."""
    parts = F.filter(F.split(F.translate(name, "-", "_"), "_"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "_")


def discriminator_classes(column: Column) -> Column:
    """Names of the classes that a discriminator column may stand for: without ``is_``, or in title case; authors and students also in general."""
    low = F.lower(column)
    alias = F.create_map(*[F.lit(x) for pair in CLASS_ALIASES.items() for x in pair])[low]
    name = F.when(low.startswith("is_"), F.substr(column, F.lit(4))).otherwise(F.coalesce(alias, title_case(column)))
    flat = F.translate(F.lower(name), "-", "_")
    none = F.array().cast("array<string>")
    author = F.when(flat.startswith("author_of_paper"), F.array(F.lit("Author_of_paper"), F.lit("Author"))).otherwise(none)
    student = F.when(flat.endswith("_student") | (flat == "student"), F.array(F.lit("Student"))).otherwise(none)
    return F.array_distinct(F.concat(F.array(name), author, student))


def kind_allows(kind: Column, wanted: str) -> Column:
    """Whether a target of some declared kind may be used as a class, data or object target; properties without more may be either."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    if wanted == "class":
        return F.contains(low, F.lit("class")) | (low == "")
    if wanted not in ("data", "object"):
        return F.lit(False)
    return F.contains(low, F.lit(wanted)) | low.isin("property", "rdf_property", "")


def leaks(request: Column) -> Column:
    """Whether a request holds a word that it must not."""
    low = F.lower(request)
    out = F.lit(False)
    for term in LEAKING_TERMS:
        out = out | F.contains(low, F.lit(term))
    return out


def json_body(answer: Column) -> Column:
    """The JSON of an answer: without a fence around it, else from the first to the last bracket; null if there is none."""
    t = F.trim(answer)
    bare = F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?[^\S\n]*```[^\n]*$", ""))).otherwise(t)
    valid = lambda c: F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*[\[{]")
    inner = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(valid(bare), bare).when(valid(inner), inner)
