"""Score normalisation and rank fusion over long (query, item) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered
from tessera.sources.tables import small


def per_query(query: str = "query") -> Window:
    return Window.partitionBy(query)


def min_max(score: str, query: str = "query") -> Column:
    """(x - min) / max(max - min, 1e-8) over all items of the query."""
    w = per_query(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (F.col(score) - low) / F.greatest(high - low, F.lit(1e-8))


def ranked(score: str, item: str = "item", query: str = "query") -> Column:
    """Stable rank: score to nine decimals descending, then item."""
    return F.row_number().over(per_query(query).orderBy(F.round(score, 9).desc(), F.col(item)))


def reciprocal_rank(score: str, *, item: str = "item", query: str = "query", k: int = 60, top: int = 60, positive_only: bool = False) -> Column:
    """1 / (k + rank) for the first ``top`` ranks, else 0."""
    keep = ranked(score, item, query) <= top
    if positive_only:
        keep = keep & (F.col(score) > 0)
    return F.when(keep, F.lit(1.0) / (F.lit(k) + ranked(score, item, query))).otherwise(F.lit(0.0))


def rank_percentile(score: str, *, item: str = "item", query: str = "query") -> Column:
    """1 for the best item down to 0 for the last."""
    n = F.count(F.lit(1)).over(per_query(query))
    return F.lit(1.0) - (ranked(score, item, query) - 1) / F.greatest(n - 1, F.lit(1))


def adaptive(text: Column, visual: Column, confidence: Column, cap: float = 0.6) -> Column:
    """Text weighted by recognition confidence up to ``cap``, the rest visual."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(cap) * F.coalesce(confidence, F.lit(0.0))))
    return w * text + (F.lit(1.0) - w) * visual


def quality_rrf(dense: Column, lexical: Column, visual: Column, confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.lit(0.5) * c * dense + F.lit(0.5) * c * lexical + (F.lit(1.0) - F.lit(0.5) * c) * visual


def query_aware(route: Column, *, text: Column, visual: Column, lexical: Column, metadata: Column, fallback: Column, sparse: Column) -> Column:
    """Route-specific weighted sum of normalised branch scores."""
    return (
        F.when(route.isin("text_evidence", "entity_exact"), text + 0.25 * lexical)
        .when(route == "visual_metadata", 0.25 * visual + 0.75 * metadata)
        .when(route == "visual_discovery", 0.78 * visual + 0.15 * text + 0.07 * lexical)
        .when(route == "topic_discovery", text + sparse * lexical)
        .otherwise(fallback + sparse * lexical)
    )


def percentiles(rows: DataFrame, score: str, *, item: str = "item", by: tuple[str, ...] = (), out: str = "percentile") -> DataFrame:
    """``rank_percentile`` as a column of ``rows``, with a group's items spread over tasks."""
    placed = numbered(rows, [F.round(score, 9).desc(), F.col(item)], by=by, out=out)
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_items"))
    placed = placed.join(sizes, list(by)) if by else placed.crossJoin(F.broadcast(sizes))  # without groups one row
    return placed.withColumn(out, F.lit(1.0) - (F.col(out) - 1) / F.greatest(F.col("_items") - 1, F.lit(1))).drop("_items")


def scaled(rows: DataFrame, score: str, *, query: str = "query") -> DataFrame:
    """Adds ``scaled``: ``min_max`` from the extremes of each query as an aggregate; ``rows`` are read twice."""
    ends = rows.groupBy(query).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    both = rows.join(ends, query)
    return both.withColumn("scaled", (F.col(score) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-8))).drop("_low", "_high")


def first_items(items: DataFrame, score: str, k: int) -> DataFrame:
    """``(item, rank)`` of the ``k`` best items."""
    best = items.select("item", score).orderBy(F.round(score, 9).desc(), "item").limit(k)
    return best.select("item", F.row_number().over(Window.orderBy(F.round(score, 9).desc(), "item")).alias("rank"))  # k rows


def shared_ranking(items: DataFrame, queries: DataFrame, score: str, k: int) -> DataFrame:
    """``(query, item, rank)`` of a branch that scores items alike for every query: its ``k`` best, for each query of a stated set."""
    return queries.select("query").distinct().crossJoin(F.broadcast(first_items(items, score, k)))


def fused_ranks(branches: list[DataFrame], *, k: int = 60, top: int = 60) -> DataFrame:
    """``(query, item, score)``: reciprocal ranks of rankings (query, item, rank) summed; items that none ranks are left implicit.

    Every ranking has at most ``top`` rows a query, so no grid of queries and
    items is built; an item beyond them adds 0 in each branch.
    """
    parts = [b.where(F.col("rank") <= top).select("query", "item", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(i).alias("branch")) for i, b in enumerate(branches)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # One column a branch, added up in their order: a sum of floats in another order can differ in its last place.
    sides = [F.coalesce(F.max(F.when(F.col("branch") == i, F.col("part"))), F.lit(0.0)) for i in range(len(branches))]
    total = sides[0]
    for side in sides[1:]:
        total = total + side
    return every.groupBy("query", "item").agg(total.alias("score"))


def scaled_hits(hits: DataFrame, n_items: DataFrame) -> DataFrame:
    """``(query, item, scaled)``: min-max over all items of scores that are stored for hits only; other items score 0.

    ``n_items`` is one row with the number of items. The extremes are an
    aggregate: where some item is no hit, 0 is among the scores.
    """
    ends = hits.groupBy("query").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n_items.select(F.col(n_items.columns[0]).alias("n_items"))))
    some = F.col("n") < F.col("n_items")
    low, high = F.when(some, F.least("low", F.lit(0.0))).otherwise(F.col("low")), F.when(some, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))
    ends = ends.select("query", low.alias("low"), high.alias("high"))
    return hits.join(ends, "query").select("query", "item", ((F.col("score") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-8))).alias("scaled"))


def full_grid(queries: DataFrame, items: DataFrame, scores: DataFrame, fill: float) -> DataFrame:
    """Scores of every (query, item); pairs without a score get ``fill`` before any normalisation.

    For a stated, small query set; the grid has queries x items rows by design.
    """
    grid = items.select("item").join(small(queries.select("query").distinct()))
    return grid.join(scores, ["query", "item"], "left").withColumn("score", F.coalesce("score", F.lit(fill)))


def pooled_runs(runs: DataFrame, *, depth: int, k: int = 60) -> DataFrame:
    """Union of ranked runs (query, run, item, rank): reciprocal-rank sum, best rank and run count per item."""
    kept = runs.where(F.col("rank") <= depth)
    return kept.groupBy("query", "item").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("pool_score"), F.min("rank").alias("best_rank"), F.countDistinct("run").alias("n_runs")
    )


def guaranteed_pool(runs: DataFrame, *, depth: int, guaranteed: int, size: int) -> DataFrame:
    """Items any run ranks within ``guaranteed`` come first, fillers by pool order up to ``size``."""
    pool = pooled_runs(runs, depth=depth)
    order = per_query().orderBy((F.col("best_rank") <= guaranteed).desc(), F.round("pool_score", 9).desc(), "best_rank", "item")
    return pool.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= size)


def attached_candidates(queries: DataFrame, runs: dict[str, DataFrame], *, key: str, order: str, k: int = 3) -> DataFrame:
    """Every query with the ``k`` best candidates of each run, as ``run, place`` and the run's columns.

    A run has the query's ``key`` and is ordered by ``order``, best last; its
    other columns must be the same for all runs. The limit stands inside the
    lateral join, so Spark cuts a run per query before the join. A query without
    candidates in a run gets no row for it.
    """
    # The query's key gets a name of its own: Spark looks for an outer column among the inner ones first.
    asked, parts = queries.withColumnRenamed(key, "_asked"), []
    for name, run in runs.items():
        best = run.where(F.col(key) == F.col("_asked").outer()).orderBy(F.col(order).desc()).limit(k).select(*(F.col(c) for c in run.columns if c != key))
        parts.append(asked.lateralJoin(best).withColumnRenamed("_asked", key).withColumn("run", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy(F.col(order).desc()))
    return out.withColumn("place", place)
