"""Constraint sets over a table: every violation as a row."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RowRule(NamedTuple):
    """Must hold for each row; a null test is a violation."""

    name: str
    test: Column


class GroupRule(NamedTuple):
    """Must hold for each group of equal ``by`` columns; the test is over aggregates."""

    name: str
    by: tuple[str, ...]
    test: Column


def violations(rows: DataFrame, key: str, rules: Sequence[RowRule | GroupRule]) -> DataFrame:
    """``(rule, scope, key, count)``: one row per violated row rule and row key, one per violated group rule and group.

    All row rules are one array in one scan, counted per key before anything is
    shuffled; all group rules are one aggregate over grouping sets. A group's
    key is its values joined by ``|``, nulls as ``null``; ``count`` is how many
    rows of the key violate the row rule, or the group's size.
    """
    if len({r.name for r in rules}) != len(rules):
        raise ValueError("rules need names of their own")
    parts = []
    each = [r for r in rules if isinstance(r, RowRule)]
    if each:
        broken = F.array_compact(F.array(*(F.when(~F.coalesce(r.test, F.lit(False)), F.lit(r.name)) for r in each)))
        found = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.explode(broken).alias("rule"))
        parts.append(found.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("count")).select("rule", F.lit("row").alias("scope"), "key", "count"))
    grouped = [r for r in rules if isinstance(r, GroupRule)]
    if grouped:
        columns = sorted({c for r in grouped for c in r.by})
        sets = sorted({tuple(sorted(r.by)) for r in grouped})
        tests = [F.coalesce(r.test, F.lit(False)).alias(f"_t{i}") for i, r in enumerate(grouped)]
        met = rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(F.grouping_id(*columns).alias("_set"), F.count(F.lit(1)).alias("_n"), *tests)
        # A column that a set leaves out has its bit in the grouping id.
        number = lambda by: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in by)
        named = lambda by: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))
        faults = F.array_compact(F.array(*(F.when((F.col("_set") == number(r.by)) & ~F.col(f"_t{i}"), F.struct(F.lit(r.name).alias("rule"), named(r.by).alias("key"))) for i, r in enumerate(grouped))))
        found = met.select("_n", F.explode(faults).alias("f"))
        parts.append(found.select("f.rule", F.lit("group").alias("scope"), "f.key", F.col("_n").alias("count")))
    if not parts:
        raise ValueError("no rules")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def require_none(found: DataFrame) -> None:
    """Raises with the rules that were violated and how often."""
    broken = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
