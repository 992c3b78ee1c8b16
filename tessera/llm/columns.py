"""Column helpers: names that clash with nothing, values bound once, running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(documents: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``documents`` has it."""
    taken = {c.lower() for c in documents.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running ``combine`` of an int array from 0 on: same length, n * block steps at most.

    Blocks are scanned one by one, then the blocks' totals; growing one array
    entry by entry would copy it n times.
    """

    def scan(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(block)).cast("int")), lambda b: F.slice(v, b * F.lit(block) + 1, F.lit(block)))
        scanned = F.transform(blocks, scan)

        def joined(parts: Column) -> Column:
            before = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
            return bound(
                before,
                lambda at: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: combine(F.get(at, i), x)))),
            )

        return F.when(F.size(v) > 0, bound(scanned, joined)).otherwise(F.array().cast("array<int>"))

    return bound(values, whole)
