"""Incremental ingest, upserts, compaction, purges, and checks that return violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; needs no window over whole rows' ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_unique(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """Existing rows and those incoming rows whose key is new; the first of equal new keys wins."""
    fresh = first_per_key(incoming.join(existing.select(key), key, "left_anti"), key, *order)
    return existing.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key."""
    return first_per_key(current.unionByName(changes), key, F.col(version).desc())


def compact(rows: DataFrame, active: DataFrame, key: str) -> DataFrame:
    return rows.join(active.select(key).distinct(), key, "left_semi")


def purge(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def overridden(base: DataFrame, override: DataFrame, key: str, column: str) -> DataFrame:
    """``base`` with ``column`` replaced where an override exists, and whether it was."""
    new = override.select(key, F.col(column).alias("_new"), F.lit(True).alias("_has"))
    joined = base.join(new, key, "left").withColumn("used_override", F.coalesce("_has", F.lit(False)))
    return joined.withColumn(column, F.when(F.col("used_override"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_has")


def duplicated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_references(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def outside_domain(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def bounded_cache(files: DataFrame, *, name: str, size: str, newest: Column, most_files: int, most_bytes: int) -> DataFrame:
    """Files kept when the newest come first until a count or a total size is reached.

    Only the ``most_files`` newest, found by partial sorts, are added up in order.
    """
    first = files.orderBy(newest, F.col(name)).limit(most_files)
    order = Window.orderBy(newest, F.col(name)).rowsBetween(Window.unboundedPreceding, 0)
    held = first.withColumn("_sum", F.sum(size).over(order)).where(F.col("_sum") <= most_bytes).select(F.col(name).alias("_name"))
    return files.join(held, F.col(name) == F.col("_name"), "left").withColumn("kept", F.col("_name").isNotNull()).drop("_name")


def set_fingerprint(rows: DataFrame, *parts: Column) -> DataFrame:
    """Order-independent fingerprint of a relation: count and exact sum of row hashes."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).cast("string").alias("hash_sum"))
