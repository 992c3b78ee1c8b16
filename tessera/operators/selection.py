"""Sources chosen so that no two share an identity key, in rounds of parallel proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import stable_key
from tessera.sources.workspace import discard, materialize


def _hashed(key: Column) -> Column:
    """128 bits of a key: long keys, such as lines of text, travel as short ones."""
    return F.unhex(F.md5(key.cast("string").cast("binary")))


def _keyed(items: DataFrame, item: str, keys: str) -> DataFrame:
    """``(item, key)`` with hashed keys; nulls count for nothing."""
    return items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.explode(F.array_distinct(F.transform(F.array_compact(keys), _hashed))).alias("key"))


def _first(seed: str) -> Column:
    """The item that comes first by hash, then by itself."""
    return F.min(F.struct(stable_key(F.lit(seed), F.col("item")).alias("hash"), F.col("item").alias("item")))["item"]


def independent_items(items: DataFrame, *, item: str, keys: str, seed: str, excluded: DataFrame | None = None, max_rounds: int = 200) -> DataFrame:
    """``(item)``: a largest choice that cannot be extended, no two of which share a key and none of which holds an excluded one.

    Items have a fixed order by hash. In each round an item that comes first
    under all its keys is taken, and items that share a key with it leave. That
    gives what going through all items in that order one by one would give,
    in a number of rounds that grows with the logarithm of their number. Keys
    are met by aggregates, never item by item, so a key of very many items
    costs one row each. ``keys`` is an array column, nulls in it count for
    nothing; rows that repeat an item pool their keys; null items are left out.
    """
    each, barred = _keyed(items, item, keys), None
    if excluded is not None:
        barred = each.join(excluded.select(_hashed(F.col(excluded.columns[0])).alias("key")).distinct(), "key", "left_semi").select("item").distinct()
        barred = materialize(barred, "barred")
        each = each.join(barred, "item", "left_anti")
    # Only keys of two items or more can keep any two apart.
    shared = materialize(each.groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low < high").select("key"), "shared-keys")
    each = materialize(each.join(shared, "key", "left_semi").distinct(), "proposals")
    discard(shared)
    free = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item")).distinct().join(each.select("item"), "item", "left_anti")
    taken = materialize(free if barred is None else free.join(barred, "item", "left_anti"), "taken")
    for _ in range(max_rounds):
        if each.isEmpty():
            break
        first = materialize(each.groupBy("key").agg(_first(seed).alias("first")), "first")
        ahead = each.join(first, "key").groupBy("item").agg(F.bool_and(F.col("item") == F.col("first")).alias("ahead"))
        new = materialize(ahead.where("ahead").select("item"), "taken")
        blocked = each.join(new, "item", "left_semi").select("key").distinct()
        gone = each.join(blocked, "key", "left_semi").select("item").distinct()
        left = materialize(each.join(gone, "item", "left_anti"), "proposals")
        discard(each, first)
        each, taken = left, taken.unionByName(new)
    else:
        raise RuntimeError("independent_items did not finish")
    return taken


def balanced_items(items: DataFrame, quotas: DataFrame, *, item: str, keys: str, cell: str, seed: str, excluded: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """``(item, cell)``: independent items, of each cell at most its quota of ``quotas`` (cell, wanted).

    An independent choice is made and cut to what each cell still wants; then
    again among the items of cells that want more, without keys already used,
    until no such item is left. So nothing more fits: each cell is full, or all
    its other items share a key with a chosen one. ``shortfall`` tells which.
    """
    wanted = quotas.select(F.col(cell).alias("cell"), F.col("wanted").cast("long").alias("wanted")).where("wanted > 0")
    # Of rows that repeat an item, the smallest cell counts; their keys are pooled.
    pooled = items.groupBy(F.col(item).alias("item")).agg(F.min(cell).alias("cell"), F.array_distinct(F.flatten(F.collect_list(F.transform(F.array_compact(F.coalesce(F.col(keys), F.array())), lambda k: F.md5(k.cast("string").cast("binary")))))).alias("keys"))
    rows = materialize(pooled.join(wanted.select("cell"), "cell", "left_semi"), "candidates")
    used = excluded.select(F.md5(F.col(excluded.columns[0]).cast("string").cast("binary")).alias("key")) if excluded is not None else None
    chosen: DataFrame | None = None
    for _ in range(max_rounds):
        have = wanted if chosen is None else wanted.join(chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "left").select("cell", (F.col("wanted") - F.coalesce("n", F.lit(0))).alias("wanted")).where("wanted > 0")
        have = materialize(have, "wanted")
        open_ = rows.join(have, "cell")
        if chosen is not None:
            open_ = open_.join(chosen, "item", "left_anti")
        free = independent_items(open_, item="item", keys="keys", seed=seed, excluded=used).join(open_.select("item", "cell", "wanted"), "item")
        order = Window.partitionBy("cell").orderBy(stable_key(F.lit(seed), F.col("item")), "item")
        new = materialize(free.withColumn("place", F.row_number().over(order)).where("place <= wanted").select("item", "cell"), "chosen")
        if new.isEmpty():
            break
        chosen = new if chosen is None else chosen.unionByName(new)
        taken = rows.join(new, "item", "left_semi").select(F.explode("keys").alias("key")).where("key is not null")
        used = materialize((taken if used is None else used.unionByName(taken)).distinct(), "used-keys")
    else:
        raise RuntimeError("balanced_items did not finish")
    return new if chosen is None else chosen


def shortfall(chosen: DataFrame, quotas: DataFrame, cell: str) -> DataFrame:
    """``(cell, missing)`` of cells that got less than their quota."""
    have = chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    rows = quotas.select(F.col(cell).alias("cell"), "wanted").join(have, "cell", "left")
    return rows.select("cell", (F.col("wanted") - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def replaced_items(queue: DataFrame, items: DataFrame, dropped: DataFrame, *, item: str, keys: str, cell: str, seed: str) -> DataFrame:
    """``(item, cell, replacement)``: the queue without ``dropped`` items, with as many new ones in the same cells.

    New items share no key with any item of the queue, dropped ones included,
    nor with each other.
    """
    known = queue.select(F.col(item).alias("item"), F.col(cell).alias("cell")).distinct()
    gone = known.join(dropped.select(F.col(item).alias("item")).distinct(), "item", "left_semi")
    held = items.join(known.select(F.col("item").alias(item)), item, "left_semi").select(F.explode(keys).alias("key")).where("key is not null").distinct()
    fresh = items.join(known.select(F.col("item").alias(item)), item, "left_anti")
    quotas = gone.groupBy("cell").agg(F.count(F.lit(1)).alias("wanted")).withColumnRenamed("cell", cell)
    new = balanced_items(fresh, quotas, item=item, keys=keys, cell=cell, seed=seed, excluded=held)
    return known.join(gone, "item", "left_anti").withColumn("replacement", F.lit(False)).unionByName(new.withColumn("replacement", F.lit(True)))


def source_families(items: DataFrame, counts: DataFrame, *, item: str, group: str, stratum: str, order: str, seed: str) -> DataFrame:
    """``(group, stratum, target, neighbour)``: groups with two items or more, the first ``wanted`` of each stratum by hash.

    A group stands in the stratum of its first item by ``order``, then id; that
    item is the target, the next one its neighbour.
    """
    inside = Window.partitionBy(group).orderBy(order, item)
    pair = items.where(F.col(group).isNotNull()).withColumn("_at", F.row_number().over(inside)).where("_at <= 2")
    first = lambda c, n: F.max(F.when(F.col("_at") == n, F.col(c)))
    made = pair.groupBy(F.col(group).alias("group")).agg(first(stratum, 1).alias("stratum"), first(item, 1).alias("target"), first(item, 2).alias("neighbour")).where("neighbour is not null")
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(stable_key(F.lit(seed), F.col("group")), "group"))
    wanted = counts.select(F.col(stratum).alias("stratum"), "wanted")
    return made.withColumn("_place", place).join(wanted, "stratum").where("_place <= wanted").select("group", "stratum", "target", "neighbour")
