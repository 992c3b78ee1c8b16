"""Human and model review: overrides, consensus, adjudication, duplicate decisions, ranking promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_label(current: Column, human_decision: Column, human_label: Column, proposal: Column) -> Column:
    """Human reclassification, then human acceptance of the current label, then an active proposal, then the current label."""
    return F.when(human_decision == "reclassified", human_label).when(human_decision == "accepted", current).otherwise(F.coalesce(proposal, current))


def consensus(votes: DataFrame, *, case: str, vote: str, confidence: str, least: float = 0.80) -> DataFrame:
    """``(case, vote, n, n_votes, agreed)``: the leading vote, agreed when a strict majority of confident votes gives it."""
    each = votes.groupBy(case, vote).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(confidence) >= least).alias("sure"))
    w = Window.partitionBy(case)
    led = each.withColumn("n_votes", F.sum("n").over(w)).withColumn("_p", F.row_number().over(w.orderBy(F.col("sure").desc(), F.col("n").desc(), vote)))
    return led.where("_p = 1").select(case, vote, "n", "n_votes", (F.col("sure") >= F.floor(F.col("n_votes") / 2) + 1).alias("agreed"))


def adjudicated(first: DataFrame, second: DataFrame, third: DataFrame, *, case: str, decision: str) -> DataFrame:
    """First reviewer's decision, or the third's where the first two differ; ``pending`` where that is still missing."""
    rows = first.select(case, F.col(decision).alias("a")).join(second.select(case, F.col(decision).alias("b")), case).join(third.select(case, F.col(decision).alias("c")), case, "left")
    conflict = ~F.col("a").eqNullSafe(F.col("b"))
    return rows.select(case, F.when(conflict, F.col("c")).otherwise(F.col("a")).alias(decision), conflict.alias("conflict"), (conflict & F.col("c").isNull()).alias("pending"))


def duplicate_roles(items: DataFrame, decisions: DataFrame, *, item: str, keep: str, remove: str) -> DataFrame:
    """Items with their role in duplicate decisions; removed ones leave search."""
    kept = decisions.select(F.col(keep).alias(item)).distinct().withColumn("_keeps", F.lit(True))
    gone = decisions.groupBy(F.col(remove).alias(item)).agg(F.min(keep).alias("duplicate_of"))
    rows = items.join(kept, item, "left").join(gone, item, "left")
    role = F.when(F.col("duplicate_of").isNotNull(), "removed").when(F.col("_keeps"), "kept").otherwise("single")
    return rows.withColumn("dedup_role", role).withColumn("search_enabled", F.col("duplicate_of").isNull()).drop("_keeps")


def promoted(ranking: DataFrame, evidence: Column, *, query: str = "query", rank: str = "rank") -> DataFrame:
    """Rows with evidence first, each part in its old order; ``new_rank`` from 1."""
    order = Window.partitionBy(query).orderBy(F.coalesce(evidence, F.lit(False)).desc(), rank)
    return ranking.withColumn("new_rank", F.row_number().over(order))


def union_recall(a: DataFrame, b: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall of each run's first k rows and of their union, over queries that have relevant items."""
    asked = relevant.select("query").distinct()
    hit = lambda run, name: run.where(F.col("rank") <= k).join(relevant, ["query", "item"], "left_semi").select("query").distinct().withColumn(name, F.lit(1.0))
    rows = asked.join(hit(a, "a"), "query", "left").join(hit(b, "b"), "query", "left").na.fill(0.0)
    return rows.agg(F.avg("a").alias("recall_a"), F.avg("b").alias("recall_b"), F.avg(F.greatest("a", "b")).alias("recall_union"), F.count(F.lit(1)).alias("n"))


def set_scores(rows: DataFrame, gold: str, predicted: str, by: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of predicted against gold arrays."""
    from tessera.functions.numbers import f1, safe_ratio

    g, p = F.array_distinct(F.coalesce(gold, F.array())), F.array_distinct(F.coalesce(predicted, F.array()))
    counts = rows.groupBy(*by).agg(
        F.sum(F.size(F.array_intersect(g, p))).alias("tp"), F.sum(F.size(F.array_except(p, g))).alias("fp"), F.sum(F.size(F.array_except(g, p))).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def constrained_threshold(points: DataFrame, *, far: str, accept: str, most_far: float) -> DataFrame:
    """Among thresholds whose false-accept rate is low enough, the one that accepts most, then the largest."""
    return points.where(F.col(far) <= most_far + 1e-12).orderBy(F.round(accept, 9).desc(), F.col("threshold").desc()).limit(1)


def coverage_by_reviewers(judgments: DataFrame, *, query: str, reviewer: str, split: str) -> DataFrame:
    """Queries per split and number of distinct reviewers."""
    each = judgments.groupBy(split, query).agg(F.countDistinct(reviewer).alias("n_reviewers"))
    return each.groupBy(split, "n_reviewers").agg(F.count(F.lit(1)).alias("n_queries"))
