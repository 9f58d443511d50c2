"""Scores of answers, rankings and matches. Nothing that selects imports this module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import each
from ..lineage import spread

K_VALUES = (1, 3, 5, 8, 10, 16, 20)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def membership_scores(answer: DataFrame, reference: DataFrame, key: str = "k") -> DataFrame:
    """One row: how many rows of each side are members of the other, precision, recall, F1 (all 1 if both are empty).

    Rows count as often as they occur; empty rows are left out. Two semi joins on the rendered key.
    """
    a, b = (x.select(key).filter(F.col(key) != "") for x in (answer, reference))
    parts = [a.agg(F.count("*").alias("n_answer")), b.agg(F.count("*").alias("n_reference")), a.join(b, key, "left_semi").agg(F.count("*").alias("hit_answer")), b.join(a, key, "left_semi").agg(F.count("*").alias("hit_reference"))]
    one = parts[0].join(parts[1]).join(parts[2]).join(parts[3])  # one row each
    p, r = ratio(F.col("hit_answer"), F.col("n_answer")), ratio(F.col("hit_reference"), F.col("n_reference"))
    none = (F.col("n_answer") == 0) & (F.col("n_reference") == 0)
    out = one.withColumn("precision", F.when(none, 1.0).otherwise(p)).withColumn("recall", F.when(none, 1.0).otherwise(r))
    return out.withColumn("f1", F.when(none, 1.0).otherwise(f1(F.col("precision"), F.col("recall"))))


def render(df: DataFrame, iri: str = "##iri##") -> DataFrame:
    """Rows as one key ``k``, as the answer list shows them: cells as text, IRIs as the sentinel."""
    cells = [F.when(F.col(c).cast("string").rlike("^(http://|https://|urn:)"), iri).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns]
    return df.select(F.concat_ws("\u001f", *cells).alias("k"))


def first_ranks(rankings: DataFrame, gold: DataFrame, source: str, target: str, max_k: int = 20) -> DataFrame:
    """Per gold source: rank of its first gold target within ``max_k`` and anywhere, reciprocal rank, and found flags."""
    hits = rankings.join(gold.select(source, target).distinct(), [source, target]).groupBy(source).agg(F.min("rank").cast("long").alias("rank_anywhere"))
    counts = rankings.filter(F.col("rank") <= max_k).groupBy(source).agg(F.count("*").alias("candidate_count"))
    rank = F.when(F.col("rank_anywhere") <= max_k, F.col("rank_anywhere"))
    out = gold.select(source).distinct().join(hits, source, "left").join(counts, source, "left").withColumn("first_rank", rank)
    flags = [F.when(F.col("first_rank") <= k, 1).otherwise(0).alias(f"found_at_{k}") for k in K_VALUES]
    return out.select(source, "first_rank", "rank_anywhere", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), *flags)


def retrieval_metrics(details: DataFrame, by: list[str], all_of: str | None = None) -> DataFrame:
    """Recall at each k, MRR and the rest per group; ``all_of`` names the column whose rows also count in group ``all``."""
    aggs = [
        F.avg("reciprocal_rank").alias("mrr"), F.avg("first_rank").alias("mean_rank_first_gold"), F.avg((F.col("candidate_count") > 0).cast("double")).alias("candidate_coverage"),
        F.avg((F.col("candidate_count") == 0).cast("double")).alias("zero_candidate_rate"), F.count("*").alias("n"), *[F.avg(f"found_at_{k}").alias(f"_r{k}") for k in K_VALUES],
    ]
    if all_of is None:
        wide = details.groupBy(*by).agg(*aggs)
    else:
        rest = [c for c in by if c != all_of]
        wide = details.groupingSets([[F.col(c) for c in by], [F.col(c) for c in rest]], *[F.col(c) for c in by]).agg(*aggs, F.grouping(all_of).alias("_g"))
        wide = wide.withColumn(all_of, F.when(F.col("_g") == 1, "all").otherwise(F.col(all_of))).drop("_g")
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_r{k}").alias("recall_at_k")) for k in K_VALUES])).alias("x")
    return wide.select(*by, long, "mrr", "mean_rank_first_gold", "candidate_coverage", "zero_candidate_rate", "n").select(*by, "x.k", "x.recall_at_k", "mrr", "mean_rank_first_gold", "candidate_coverage", "zero_candidate_rate", "n")


# Fixed values in what follows: the names of failure categories by method, and of the buckets of outcomes.


def failure_category(method: str, wrong_kind: Column, rank_anywhere: Column, count: Column, gap: Column) -> Column:
    """Why a source's gold target wasn't found, first reason that holds; null where it was."""
    by_method = {"levenshtein": "lexical_rename_failure", "dense": "dense_semantic_failure", "bm25": "bm25_tokenization_failure", "hybrid_levenshtein_dense": "hybrid_fusion_failure", "hybrid_bm25_dense": "hybrid_fusion_failure"}
    return (
        F.when(count == 0, "zero_candidates").when(wrong_kind, "wrong_kind_filtering").when(rank_anywhere > 20, "correct_target_rank_too_low").when(gap <= 1e-12, "ambiguous_candidates").otherwise(by_method.get(method, "correct_target_not_retrieved"))
    )


def top_gap(rankings: DataFrame, source: str) -> DataFrame:
    """Difference of a source's two best scores."""
    two = rankings.filter("rank <= 2").groupBy(source).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return two.select(source, F.abs(F.col("a") - F.col("b")).alias("gap"))


def best_methods(rows: DataFrame, by: list[str], method: str, score: str, difficult: float = 0.95) -> DataFrame:
    """Each group's method with the highest score, the first by name between equal ones, and whether even that is below ``difficult``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), method)
    best = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return best.select(*by, method, score, (F.col(score) < difficult).alias("difficult"))


#: Words of a passage that lead to its documents, and passages that are broadcast at most.
GRAM, PASSAGES = 5, 20_000


def holders(docs: DataFrame, passages: DataFrame, doc: str, item: str, column: str = "text") -> DataFrame:
    """(item, doc) for each document whose text holds the passage's text somewhere.

    Between spaces inside a passage stand whole words of any text that holds it: its second to sixth word lead to the
    documents with that run of words, which are then looked into. Passages of fewer than seven words have no such run:
    a document looks for each of them, while they are few; more than that are an error.
    """
    split = passages.select(item, F.col(column).alias("_passage"), F.split(column, " ").alias("_w"))
    long = split.filter(F.size("_w") >= GRAM + 2).select(item, "_passage", F.xxhash64(F.slice("_w", 2, GRAM)).alias("_k"))
    short = split.filter(F.size("_w") < GRAM + 2).select(item, "_passage")
    few, count = short.count(), passages.count()
    if few > PASSAGES:
        raise ValueError(f"{few} passages of fewer than {GRAM + 2} words")
    words = spread(docs).select(doc, F.col(column).alias("_text"), F.split(column, " ").alias("_w"))
    spots = F.when(F.size("_w") >= GRAM, F.transform(F.sequence(F.lit(1), F.size("_w") - GRAM + 1), lambda i: F.xxhash64(F.slice("_w", i, GRAM))))
    runs = each(words.select(doc, F.array_distinct(spots).alias("_s")), "_s", "_k")
    met = runs.join(F.broadcast(long) if count <= PASSAGES else long, "_k").select(doc, item, "_passage")
    found = met.join(docs.select(doc, F.col(column).alias("_text")).distinct(), doc).filter(F.contains("_text", F.col("_passage"))).select(item, doc).distinct()
    if not few:
        return found
    near = words.select(doc, "_text").join(F.broadcast(short), F.contains("_text", F.col("_passage"))).select(item, doc)
    return found.unionByName(near.distinct())


def matching_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of (predicted, gold, correct, invalid, api_error, confidence): nineteen measures per group.

    candidate_rank and runtime_seconds count where rows have them.
    """
    for name in ("candidate_rank", "runtime_seconds"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    good = ~F.col("invalid") & ~F.col("api_error")
    has_gold, said = F.col("gold").isNotNull(), F.col("predicted").isNotNull()
    out = rows.groupBy(*by).agg(
        F.count("*").alias("evaluated_sources"), F.count_if(has_gold).alias("gold_mapped_sources"), F.count_if(said & good).alias("predicted_matches"), F.count_if(~said & good).alias("predicted_nulls"),
        F.count_if(has_gold & F.col("correct")).alias("true_positives"), F.count_if(has_gold & said & ~F.col("correct") & good).alias("false_positives"),
        F.count_if("invalid").alias("invalid_selections"), F.count_if("api_error").alias("api_errors"), F.count_if(F.col("invalid") | F.col("api_error")).alias("_bad"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.avg("candidate_rank").alias("avg_candidate_rank"), F.coalesce(F.sum("runtime_seconds"), F.lit(0.0)).alias("runtime_seconds"), F.count_if(~has_gold).alias("unlabeled_sources"),
    )
    out = out.withColumns({f"all_source_{n}": F.col(n) for n in ("predicted_matches", "predicted_nulls")})
    out = out.withColumn("false_negatives", F.col("gold_mapped_sources") - F.col("true_positives"))
    out = out.withColumn("precision", ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))).withColumn("recall", ratio(F.col("true_positives"), F.col("gold_mapped_sources")))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.withColumn("error_rate", ratio(F.col("false_positives") + F.col("false_negatives") + F.col("_bad"), F.col("evaluated_sources"))).drop("_bad")


def confusion_bucket() -> Column:
    """One of seven disjoint outcomes of a row."""
    gold, said = F.col("gold").isNotNull(), F.col("predicted").isNotNull()
    return (
        F.when(F.col("api_error"), "api_error").when(F.col("invalid"), "invalid_selection").when(gold & F.col("correct"), "selected_correct").when(gold & said, "selected_wrong")
        .when(gold, "null_when_gold_match").when(said, "selected_when_gold_null").otherwise("null_when_gold_null")
    )


def majority_votes(samples: DataFrame, source: str, ranks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source the decision with most votes: ties by mean confidence, rank, a match before none; a weak tie is none.

    samples: (source, predicted or null, confidence); ranks: (source, predicted, rank). Disagreement is 1 - votes/all.
    """
    votes = samples.groupBy(source, "predicted").agg(F.count("*").alias("votes"), F.avg("confidence").alias("avg_confidence"))
    votes = votes.join(ranks, [source, "predicted"], "left").withColumn("rank", F.coalesce("rank", F.lit(10**9)))
    w = Window.partitionBy(source)
    best = w.orderBy(F.desc("votes"), F.desc(F.round("avg_confidence", 9)), "rank", F.col("predicted").isNull(), "predicted")
    out = votes.withColumn("_r", F.row_number().over(best)).withColumn("_all", F.sum("votes").over(w)).withColumn("_top", F.max("votes").over(w))
    out = out.withColumn("_ties", F.count_if(F.col("votes") == F.col("_top")).over(w)).filter("_r = 1")
    weak = (F.col("_ties") > 1) & F.col("predicted").isNotNull() & (F.col("avg_confidence") < threshold)
    return out.select(source, F.when(~weak, F.col("predicted")).alias("predicted"), "votes", (F.col("_ties") > 1).alias("tie"), (1 - F.col("votes") / F.col("_all")).alias("disagreement"))


def gold_from_queries(sql_use: DataFrame, graph_use: DataFrame) -> DataFrame:
    """Gold pairs: what a query pair's SQL reads and its graph query names, of the same kind."""
    return sql_use.join(graph_use, ["query_id", "kind"]).select("source_id", "target").distinct()


def candidate_evaluation(rankings: DataFrame, gold: DataFrame, sources: DataFrame, max_k: int = 20) -> dict[str, DataFrame]:
    """The tables of an evaluation of candidate methods: details, failures, metrics by scenario, overall and by role, best methods, gold.

    rankings: scenario, method, source, target, score, rank; gold: scenario, source, target; sources: scenario, source,
    kind, role. Every method of a scenario is judged on all its gold sources.
    """
    methods = rankings.select("scenario", "method").distinct()
    wanted = gold.join(methods, "scenario")
    name = F.concat_ws("\u001f", "scenario", "method", "source")
    keyed = first_ranks(rankings.withColumn("_key", name), wanted.withColumn("_key", name), "_key", "target", max_k)
    parts = F.split("_key", "\u001f")
    details = keyed.select(*[parts[i].alias(c) for i, c in enumerate(("scenario", "method", "source"))], *[c for c in keyed.columns if c != "_key"]).join(sources.select("scenario", "source", "kind", "role"), ["scenario", "source"])
    gaps = top_gap(rankings.withColumn("_key", name), "_key")
    lost = details.filter("first_rank IS NULL").withColumn("_key", name).join(gaps, "_key", "left").drop("_key")
    category = F.lit(None).cast("string")
    for m in [r.method for r in methods.select("method").distinct().collect()]:  # a row a method
        category = F.when(F.col("method") == m, failure_category(m, F.lit(False), F.col("rank_anywhere"), F.col("candidate_count"), F.col("gap"))).otherwise(category)
    by_scenario = retrieval_metrics(details, ["scenario", "method", "kind"], "kind")
    at_most = by_scenario.filter((F.col("kind") == "all") & (F.col("k") == max(K_VALUES))).select("scenario", "method", F.col("recall_at_k").alias("recall"))
    return {
        "gold": gold,
        "details": details,
        "failures": lost.select("scenario", "method", "source", "kind", "candidate_count", category.alias("failure_category")),
        "metrics_by_scenario": by_scenario,
        "metrics_overall": retrieval_metrics(details, ["method", "kind"], "kind"),
        "metrics_by_role": retrieval_metrics(details, ["method", "role"]),
        "best_methods": best_methods(at_most, ["scenario"], "method", "recall"),
    }
