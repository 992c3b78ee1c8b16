"""Features of a query's rankings for acceptance gates, in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_features(rankings: DataFrame, *, main: str, methods: Sequence[str], signals: Sequence[str], aligned: Mapping[str, Sequence[tuple[str, float]]], depth: int = 10, query: str = "query") -> DataFrame:
    """One row per query of ``rankings`` (query, method, item, rank, relevant, signals...).

    Of the ``main`` ranking's first ``depth`` rows: its first item, each
    signal's best value and lead over the next (``max_x``, ``margin_x``; 0
    where there is none), and how many rows reach all bounds of each entry of
    ``aligned``. Of every method: the rank of the first relevant item
    (``rank_m``, null if none). The first rows are a list of at most ``depth``,
    so one aggregate by query gives all; rankings need ranks without ties.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    top = F.when((F.col("method") == main) & (F.col("rank") <= depth), F.struct("rank", "item", *map(value, signals)))
    first = [F.min(F.when((F.col("method") == m) & F.col("relevant"), F.col("rank"))).alias(f"rank_{m}") for m in methods]
    rows = rankings.groupBy(query).agg(F.collect_list(top).alias("_top"), *first)

    def best(s: str, n: int) -> Column:
        ordered = F.sort_array(F.transform("_top", lambda r: r[s]), asc=False)
        return F.coalesce(F.get(ordered, F.lit(n)), F.lit(0.0))

    def reaches(bounds: Sequence[tuple[str, float]]) -> Column:
        def all_of(r: Column) -> Column:
            held = F.lit(True)
            for s, least in bounds:
                held = held & (r[s] >= least)
            return held

        return F.size(F.filter("_top", all_of))

    out = {"top_item": F.get(F.array_sort("_top"), F.lit(0))["item"]}
    for s in signals:
        # A lead needs a second row: a single one leads over 0, as values are not negative.
        out |= {f"max_{s}": best(s, 0), f"margin_{s}": best(s, 0) - best(s, 1)}
    return rows.withColumns(out | {name: reaches(bounds) for name, bounds in aligned.items()}).drop("_top")


def snapshot(rankings: DataFrame, methods: Sequence[str], depth: int = 20) -> DataFrame:
    """The first rows of some methods before any gate, for a user who asks to see them."""
    return rankings.where(F.col("method").isin(*methods) & (F.col("rank") <= depth))
