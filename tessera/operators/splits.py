"""Leakage-safe grouping, hash splits, diverse and blind orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import stable_key
from tessera.operators.graph import connected_components


def token_groups(items: DataFrame, item: str, keys: list[Column]) -> DataFrame:
    """``(item, group)``: items that share any key, directly or over others; group is the smallest item.

    Each key's items are linked to its smallest item, one row per item, so a
    key that very many items share costs no pairs.
    """
    each = items.select(F.col(item).alias("item"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    lead = each.groupBy("key").agg(F.min("item").alias("lead"))
    links = each.join(lead, "key").select(F.col("item").alias("src"), F.col("lead").alias("dst"))
    groups = connected_components(links)
    joined = items.select(F.col(item).alias("item")).distinct().join(groups, F.col("item") == F.col("node"), "left")
    return joined.select("item", F.coalesce("component", "item").alias("group"))


def hash_split(key: Column, shares: dict[str, float], seed: str) -> Column:
    """Split name by a stable hash of ``key`` alone."""
    from tessera.functions.numbers import stable_fraction

    u, upto, out = stable_fraction(F.lit(seed), key), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = (F.when if out is None else out.when)(u < upto, F.lit(name))
    return F.lit(names[0]) if out is None else out.otherwise(F.lit(names[-1]))


def leaking_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split; must be empty."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def diverse_order(rows: DataFrame, *, group: str, item: str, seed: str) -> DataFrame:
    """Round robin over groups, hash order inside each: ``position`` from 1.

    Only the number inside a group needs its rows together; the final order is
    a range sort.
    """
    inside = Window.partitionBy(group).orderBy(stable_key(F.lit(seed), F.col(item)), F.col(item))
    return rows.withColumn("turn", F.row_number().over(inside)).withColumn("group_key", stable_key(F.lit(seed), F.col(group)))


def blind_order(pool: DataFrame, *, query: str, item: str, fingerprint: str) -> DataFrame:
    """Anonymous candidate names in an order that depends on hashes alone."""
    order = Window.partitionBy(query).orderBy(stable_key(F.lit(fingerprint), F.col(query), F.col(item)), F.col(item))
    place = F.row_number().over(order)
    return pool.withColumn("position", place).withColumn("alias", F.concat(F.lit("C"), F.lpad(F.col("position").cast("string"), 3, "0")))


def evenly_spaced(rows: DataFrame, *, order: str, by: str, count: int) -> DataFrame:
    """Of each group the rows at round(i (n - 1) / (count - 1)), i < count, in ``order``."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(count - 1)).cast("int"))
    return numbered.where((F.col("_n") <= count) | F.array_contains(places, F.col("_at"))).drop("_at", "_n")


def top_per_group(rows: DataFrame, k: int, *order: Column, by: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def cumulative_fill(groups: DataFrame, *, size: str, key: str, share: float, seed: str) -> DataFrame:
    """Whole groups in hash order, assigned to "calibration" until a share of rows is reached, then "holdout"."""
    order = Window.partitionBy().orderBy(stable_key(F.lit(seed), F.col(key)), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size).over(Window.partitionBy())
    return groups.withColumn("split", F.when(F.sum(size).over(order) <= F.lit(share) * total, F.lit("calibration")).otherwise(F.lit("holdout")))
