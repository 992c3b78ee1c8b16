"""Retrieval and classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import f1, safe_ratio


def first_relevant_rank(rankings: DataFrame, relevant: DataFrame) -> DataFrame:
    """``(query, best_rank)`` for every query of ``rankings``; null where nothing relevant is ranked."""
    hits = rankings.join(relevant, ["query", "item"], "left_semi").groupBy("query").agg(F.min("rank").alias("best_rank"))
    return rankings.select("query").distinct().join(hits, "query", "left")


def recall_at(k: int, rank: str = "best_rank") -> Column:
    return F.coalesce(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mean_reciprocal_rank(rank: str = "best_rank") -> Column:
    return F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0))), F.lit(0.0))


def ndcg(rankings: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Binary nDCG@k per query that has relevant items."""
    gains = rankings.where(F.col("rank") <= k).join(relevant, ["query", "item"], "left_semi")
    gains = gains.groupBy("query").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return ideal.join(gains, "query", "left").select("query", (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def ndcg_counted(rows: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """``ndcg`` of the first ``k`` rows (query, rank, relevant) of each query, given how many items are relevant to it (query, n)."""
    gains = rows.where((F.col("rank") <= k) & F.col("relevant")).groupBy("query").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return counts.join(gains, "query", "left").select("query", (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def gated_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Ranker and product metrics of rows (answerable, accepted, best_rank); a product metric is 0 where not accepted.

    Empty denominators give 0. End to end: an answerable query is right when
    accepted with rank 1, one without an answer when rejected.
    """
    yes, no = F.col("answerable"), ~F.col("answerable")
    hit = lambda k: F.coalesce(F.col("best_rank") <= k, F.lit(False))
    share = lambda what, among: safe_ratio(F.count_if(what & among), F.count_if(among))
    right = (yes & F.col("accepted") & hit(1)) | (no & ~F.col("accepted"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        share(hit(1), yes).alias("recall_1"),
        share(hit(10), yes).alias("recall_10"),
        share(hit(1) & F.col("accepted"), yes).alias("product_recall_1"),
        share(F.col("accepted"), yes).alias("acceptance"),
        share(~F.col("accepted"), no).alias("rejection"),
        share(F.col("accepted"), no).alias("false_accept_rate"),
        safe_ratio(F.count_if(right), F.count(F.lit(1))).alias("end_to_end"),
    )


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class of a confusion table; classes never predicted or never gold count 0."""
    gold = counts.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("gold_n"))
    said = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said_n"))
    both = counts.where("gold = predicted").select(F.col("gold").alias("label"), F.col("n").alias("tp"))
    rows = gold.join(said, "label", "full").join(both, "label", "left").na.fill(0)
    return rows.select(
        "label", safe_ratio(F.col("tp"), F.col("said_n")).alias("precision"), safe_ratio(F.col("tp"), F.col("gold_n")).alias("recall"),
        f1(F.col("tp"), F.col("said_n") - F.col("tp"), F.col("gold_n") - F.col("tp")).alias("f1"),
    )


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa) for two raters; null kappa without pairs."""
    cells = confusion(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows = cells.groupBy("gold").agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(F.col("predicted").alias("gold")).agg(F.sum("n").alias("col_n"))
    chance = rows.join(columns, "gold").agg(F.sum(F.col("row_n").cast("double") * F.col("col_n")).alias("products"))
    seen = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("agree"))
    made = seen.crossJoin(chance).select(
        "n", (F.col("agree") / F.col("n")).alias("observed"), (F.coalesce("products", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))).alias("expected")
    )
    same = F.abs(F.col("expected") - 1) < 1e-12
    degenerate = F.when(F.abs(F.col("observed") - 1) < 1e-12, 1.0).otherwise(0.0)
    return made.withColumn("kappa", F.when(same, degenerate).otherwise((F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0))))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    placed = rows.select(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin"), F.col(confidence).alias("c"), F.col(correct).cast("double").alias("ok"))
    each = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("c"), F.avg("ok").alias("ok"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("ok") - F.col("c"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of each (before, after) pair and whether it is a change."""
    return rows.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(
        F.count(F.lit(1)).alias("n"), F.max(~F.col(before).eqNullSafe(F.col(after))).alias("changed")
    )
