"""URL filter: rules by host suffix and path prefix, then a character language-model ratio.

Two variable-order Markov models of URL characters, of accepted and of rejected URLs, give each character a smoothed
log-likelihood; the URL's score is the mean difference over its characters, and the threshold between accepted and
rejected is calibrated on rule-labelled URLs that the models haven't seen. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path prefix); the longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: One URL in so many of the rule-labelled ones is kept from the models and calibrates the threshold.
HELD_OUT = 5
ORDER = 4
#: Pseudo-count of the next shorter context's estimate.
BACKOFF = 4.0
BINS = 400
#: Distinct grams whose ratios are broadcast at most: some 30 MB.
BROADCAST_GRAMS = 300_000


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def whole(url: Column) -> Column:
    """What the models read: all of the URL behind the first ``://``, with the host in lower case."""
    rest = F.substr(url, F.locate("://", url) + F.lit(3))
    return F.when(F.locate("://", url) > 0, F.concat(_ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_replace(rest, r"^[^/?#]*", ""))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together; between equals the smaller text) and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(x) for x in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of a URL with the characters before it: ``gram`` has up to ``order`` of them and ends with it."""
    padded = F.concat(F.lit("\u0002" * (order - 1)), F.col("_u"), F.lit("\u0003"))
    n = F.length("_u") + 1
    spots = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(padded, i, F.lit(order)))
    return urls.withColumn("gram", F.explode_outer(spots))  # a URL has one spot at least


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """Host, path, rule, verdict and score of every row of ``pages``.

    A rule's verdict holds; else the model's, which reads the whole URL and learns from nothing but the rules' verdicts
    on other URLs of the table. A null URL or one without ``://`` has empty host and path, no rule, and is judged as an
    empty URL is. Without rule-labelled URLs of either kind both models are uniform and all such rows are allowed.
    Repeated rows and URLs are counted once in the models and judged alike; a score at the threshold is allowed. A very
    long URL is a row a character. Only the id and URL columns are read; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("_url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", host.alias("host"), path.alias("path"), F.coalesce(whole(F.col("_url")), F.lit("")).alias("_u"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", "_u", rule.alias("rule"), verdict.alias("_ruled"))
    # equal URLs are one to the models and are scored once
    urls = base.groupBy("_u").agg(F.first("_ruled").alias("_ruled")).withColumn("_key", F.xxhash64("_u"))
    seen = F.when(F.pmod("_key", F.lit(HELD_OUT)) != 0, F.col("_ruled"))
    good, bad = (F.sum(F.when(seen == v, 1).otherwise(0)) for v in ("allow", "block"))
    grams = _grams(urls.select("_key", "_ruled", "_u"), order)
    full = scratch.keep(grams.groupBy("gram").agg(good.alias("g"), bad.alias("b")), "grams")
    ratio = scratch.keep(_ratios(full, order), "ratios")
    if full.count() <= BROADCAST_GRAMS:
        ratio = F.broadcast(ratio)
    # a URL's score needs its grams' ratios only: one join on the gram, summed per URL on the map side
    scores = scratch.keep(grams.join(ratio, "gram").groupBy("_key", "_u").agg(F.avg("ratio").alias("_score"), F.first("_ruled").alias("_r")), "scores")
    cut = _threshold(scores).first()["_cut"]  # one number
    scored = base.join(scores.select("_u", "_score"), "_u", "left")
    model = F.when(F.col("_score") < F.lit(cut), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_ruled", model).alias("verdict"), F.col("_score").alias("score"))


def _ratios(full: DataFrame, order: int) -> DataFrame:
    """Log-likelihood difference of each gram's last character given those before it, interpolated over all orders.

    ``full`` has a row for each distinct gram, with counts under both models. P_k = (count + BACKOFF * P_(k-1)) /
    (context count + BACKOFF), down to a uniform 1/256.
    """
    out = full.select("gram", F.lit(1 / 256).alias("pg"), F.lit(1 / 256).alias("pb"))
    for k in range(1, order + 1):
        tail = F.substr(F.col("gram"), F.lit(order - k + 1), F.lit(k))
        context = F.substr(F.col("gram"), F.lit(order - k + 1), F.lit(k - 1)) if k > 1 else F.lit("")
        counts = full.groupBy(tail.alias("_t")).agg(F.sum("g").alias("cg"), F.sum("b").alias("cb"))
        totals = full.groupBy(context.alias("_c")).agg(F.sum("g").alias("tg"), F.sum("b").alias("tb"))
        out = out.withColumn("_t", tail).withColumn("_c", context).join(counts, "_t").join(totals, "_c")
        out = out.select(
            "gram",
            ((F.col("cg") + BACKOFF * F.col("pg")) / (F.col("tg") + BACKOFF)).alias("pg"),
            ((F.col("cb") + BACKOFF * F.col("pb")) / (F.col("tb") + BACKOFF)).alias("pb"),
        )
    return out.select("gram", (F.log("pg") - F.log("pb")).alias("ratio"))


def _threshold(scores: DataFrame) -> DataFrame:
    """One row ``_cut``: the bin edge with the best balanced accuracy on held-out rule-labelled URLs (0 without both kinds).

    Scores are counted in ``BINS`` bins of [-4, 4), so the window over all bins sees at most that many rows.
    """

    held = scores.filter(F.col("_r").isNotNull() & (F.pmod("_key", F.lit(HELD_OUT)) == 0))
    bin_ = F.least(F.greatest(F.floor((F.col("_score") + 4) * (BINS / 8)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = held.groupBy(bin_.alias("bin")).agg(F.count_if(F.col("_r") == "allow").alias("a"), F.count_if(F.col("_r") == "block").alias("d"))
    below, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = counts.select(
        ((F.col("bin") * (8 / BINS)) - 4).alias("edge"),
        (F.try_divide(F.coalesce(F.sum("d").over(below), F.lit(0)), F.sum("d").over(everything)) - F.try_divide(F.coalesce(F.sum("a").over(below), F.lit(0)), F.sum("a").over(everything))).alias("gain"),
    )
    best = edges.filter("gain is not null").agg(F.max(F.struct("gain", -F.abs("edge"), "edge")).alias("m"))
    return best.select(F.coalesce(F.col("m.edge"), F.lit(0.0)).alias("_cut"))
