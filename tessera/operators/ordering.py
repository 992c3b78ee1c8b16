"""Places in an order without a group in one task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workspace import materialize


def numbered(rows: DataFrame, order: Iterable[Column], *, by: Iterable[str] = (), out: str = "n", slices: int | None = None) -> DataFrame:
    """Adds ``out``: the place from 1 of every row in ``order``, within the groups ``by`` (null is a group).

    Rows are dealt out by ranges of group and order, written once with the
    number of their slice, and numbered inside it; what stands in earlier slices
    of the group is added. Only counts by group and slice meet in a window, so a
    group of any size is spread over ``slices`` (by default the shuffle
    partitions). Ties that ``order`` does not break share a slice and get their
    places in any order, so name a key last. An empty table stays empty.
    """
    by, order = list(by), list(order)
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The slice is stored: a lost task may be dealt out anew, the table is not.
    laid = materialize(rows.repartitionByRange(n, *by, *order).withColumn("_slice", F.spark_partition_id()), "ordered")
    counted = laid.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("_slice", *(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = laid.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)))
    same = inside["_slice"] == before["_slice"]
    for i, b in enumerate(by):
        same = same & inside[b].eqNullSafe(before[f"_by{i}"])
    return inside.join(before, same).select(*(inside[c] for c in rows.columns if c != out), (inside[out] + before["_before"]).alias(out))


def neighbours(queries: DataFrame, items: DataFrame, k: int, *, by: str | None = None) -> DataFrame:
    """``(query, item)``: the ``k`` ids before and after each query among the distinct ids of ``items`` (item), with ``by`` those of its group.

    Places are numbered and met by equality, so no group is in one task. The
    query must be among the items; a null group has no neighbours.
    """
    groups = [by] if by else []
    placed = materialize(numbered(items.dropna().distinct(), [F.col("item")], by=groups, out="place"), "places")
    own = queries.select("query", *groups).distinct().join(placed.withColumnRenamed("item", "query"), ["query", *groups])
    near = F.explode(F.array(*(F.col("place") + i for i in range(-k, k + 1) if i)))
    return own.withColumn("place", near).join(placed, ["place", *groups]).select("query", "item")
