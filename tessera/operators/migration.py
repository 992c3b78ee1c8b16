"""Versions of a manifest: a chain of steps, each with the way back.

A step that replaces something keeps what was there under ``was`` in a struct
column, so going back needs no other table. ``schema_version`` tells where a
row stands; rows of different versions may lie in one table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION, WAS = "schema_version", "was"
Move = Callable[[DataFrame], DataFrame]


class Step(NamedTuple):
    """From ``version`` to the next (``up``) and back (``down``); both keep rows and their order of columns but for ``was``."""

    version: int
    up: Move
    down: Move


def _kept(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` under ``was.name``; the struct is made if there is none."""
    if WAS in rows.columns:
        return rows.withColumn(WAS, F.col(WAS).withField(name, value))
    return rows.withColumn(WAS, F.struct(value.alias(name)))


def _restored(rows: DataFrame, name: str) -> DataFrame:
    fields = [f.name for f in rows.schema[WAS].dataType.fields]
    return rows.drop(WAS) if fields == [name] else rows.withColumn(WAS, F.col(WAS).dropFields(name))


def mapped(version: int, column: str, mapping: Mapping[str, str], default: str | None = None) -> Step:
    """Values of a column under a map, many to one allowed; others become ``default`` or stay."""

    def up(rows: DataFrame) -> DataFrame:
        pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
        new = F.coalesce(F.element_at(pairs, F.col(column)), F.lit(default) if default is not None else F.col(column))
        return _kept(rows, f"v{version}", F.col(column)).withColumn(column, F.when(F.col(column).isNotNull(), new))

    return Step(version, up, lambda rows: _restored(rows.withColumn(column, F.col(f"{WAS}.v{version}")), f"v{version}"))


def partitioned_tags(version: int, tags: str, kept: Sequence[str], target: str) -> Step:
    """Tags among ``kept`` stay, the others move to ``target.other``; the order of both is what it was."""

    def up(rows: DataFrame) -> DataFrame:
        stays = lambda t: t.isin(*kept)
        parts = F.struct(F.filter(tags, lambda t: ~F.coalesce(stays(t), F.lit(False))).alias("other"))
        rows = _kept(rows, f"v{version}", F.col(tags)).withColumn(target, parts)
        return rows.withColumn(tags, F.filter(tags, lambda t: F.coalesce(stays(t), F.lit(False))))

    return Step(version, up, lambda rows: _restored(rows.withColumn(tags, F.col(f"{WAS}.v{version}")).drop(target), f"v{version}"))


def overridden_by_review(version: int, key: str, column: str, reviews: DataFrame, decision: str) -> Step:
    """A column's value as reviewed (one row a key in ``reviews``), where there is a review."""

    def up(rows: DataFrame) -> DataFrame:
        said = reviews.select(F.col(key), F.col(decision).alias("_said"))
        met = rows.join(said, key, "left").select(*rows.columns, "_said")
        return _kept(met, f"v{version}", F.col(column)).withColumn(column, F.coalesce("_said", F.col(column))).drop("_said")

    return Step(version, up, lambda rows: _restored(rows.withColumn(column, F.col(f"{WAS}.v{version}")), f"v{version}"))


def _in_order(steps: Sequence[Step]) -> list[Step]:
    ordered = sorted(steps, key=lambda s: s.version)
    if [s.version for s in ordered] != list(range(ordered[0].version, ordered[0].version + len(ordered))):
        raise ValueError("versions must follow one another")
    return ordered


def migrated(rows: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Rows of the first version at the last one; rows of another version fail."""
    ordered = _in_order(steps)
    out = _at(rows, ordered[0].version)
    for s in ordered:
        out = s.up(out)
    return out.withColumn(VERSION, F.lit(ordered[-1].version + 1))


def reset(rows: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The way back: what ``migrated`` was given, to the column."""
    ordered = _in_order(steps)
    out = _at(rows, ordered[-1].version + 1)
    for s in reversed(ordered):
        out = s.down(out)
    return out.withColumn(VERSION, F.lit(ordered[0].version))


def _at(rows: DataFrame, version: int) -> DataFrame:
    right = F.assert_true(F.col(VERSION) == version, F.concat(F.lit(f"expected version {version}, found "), F.coalesce(F.col(VERSION).cast("string"), F.lit("none"))))
    return rows.where(right.isNull())
