"""Exact rolling median and median absolute deviation of event series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.workspace import discard, materialize

MINUTE = 60_000_000
#: Widths of a slice, each a whole fraction of the one before: a slice with too many clicks is cut into those of the next width.
WIDTHS = (720 * MINUTE, 15 * MINUTE, MINUTE)
SLICE_CLICKS = 32_768  # more clicks than this in a slice: the next width
CELLS = 1 << 23  # entries of a table of run positions
EDGE_VALUES = 1 << 21  # values of edge panes looked at in one step

OUT = "click_id long, series string, n long, median2 long, mad4 long, far boolean"


def microseconds(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as written, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    since = ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    whole = F.extract(F.lit("DAY"), since) * 86_400 + F.extract(F.lit("HOUR"), since) * 3_600 + F.extract(F.lit("MINUTE"), since) * 60
    return whole.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


class Runs:
    """Values of one slice: pre-sorted short panes, and windows over them.

    ``us`` and ``cents`` are the slice's and its edge's values in order of
    time, ``middle`` values with counts that lie in every window. A pane's
    sorted run is kept as the positions of all distinct values in it, summed
    over the panes before, so the rank of a value among any neighbouring whole
    panes is the difference of two entries. A window is its whole panes, the
    middle, and the values of two edge panes filtered by time.
    """

    def __init__(self, us: np.ndarray, cents: np.ndarray, middle: np.ndarray, weight: np.ndarray):
        self.us = us
        self.values, place = np.unique(np.concatenate([cents, middle]), return_inverse=True)
        self.rank, d = place[: len(cents)], len(self.values)
        # Short panes bounded by times, as short as hold a few values each; values of one time are never parted.
        panes = int(max(1, min(len(us) // 16, CELLS // max(d, 1))))
        starts = us[len(us) * np.arange(panes) // panes] if len(us) else us
        self.edge = np.unique(np.concatenate([[0], np.searchsorted(us, starts), [len(us)]]))
        panes = len(self.edge) - 1
        pane = np.repeat(np.arange(panes), np.diff(self.edge))
        runs = np.bincount(pane * d + self.rank, minlength=panes * d).reshape(panes, d)
        self.at = np.zeros((panes + 1, d + 1), dtype=np.int32)
        np.cumsum(np.cumsum(runs, axis=1, dtype=np.int32), axis=0, out=self.at[1:, 1:])
        self.common = np.concatenate([[0], np.cumsum(np.bincount(place[len(cents) :], weights=weight, minlength=d))]).astype(np.int64)

    def windows(self, ends: np.ndarray, window: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """``(which ends, n, median2, mad4)`` in blocks that bound the edge values in memory; medians mean nothing where n < 2."""
        lo, hi = np.searchsorted(self.us, ends - window, "right"), np.searchsorted(self.us, ends, "right")
        left, right = np.searchsorted(self.edge, lo), np.searchsorted(self.edge, hi, "right") - 1
        inside = left < right
        left, right = np.where(inside, left, 0), np.where(inside, right, 0)
        # Values before the first whole pane and after the last; without whole panes all of the window's.
        one = np.where(inside, self.edge[left], hi) - lo
        two = np.where(inside, hi - self.edge[right], 0)
        size = np.cumsum(one + two)
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + EDGE_VALUES, "right")))
            yield slice(a, b), *self._select(lo[a:b], hi[a:b], left[a:b], right[a:b], one[a:b], two[a:b])
            a = b

    def _select(self, lo, hi, left, right, one, two):
        each = np.stack([one, two], axis=1).ravel()
        begin = np.stack([lo, self.edge[right]], axis=1).ravel()
        ends = np.cumsum(each)
        flat = self.rank[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each - begin, each)]
        stop = ends[1::2]
        start = np.concatenate([[0], stop[:-1]])
        size = stop - start
        counted = np.zeros(len(flat) + 1, dtype=np.int64)

        def below(rank: np.ndarray) -> np.ndarray:
            """For each window, how many of its values come before the value of this rank."""
            np.cumsum(flat < np.repeat(rank, size), out=counted[1:])
            return self.at[right, rank] - self.at[left, rank] + self.common[rank] + counted[stop] - counted[start]

        n = below(np.full(len(lo), len(self.values)))
        some = n > 0

        def ranked(k: np.ndarray) -> np.ndarray:
            """The k-th smallest value of every window by bisecting ranks over all its runs at once."""
            a, b = np.zeros(len(k), dtype=np.int64), np.full(len(k), max(len(self.values) - 1, 0))
            while (a < b).any():
                m = (a + b) // 2
                enough = below(m + 1) >= k
                a, b = np.where(enough, a, np.minimum(m + 1, b)), np.where(enough, m, b)
            return self.values[a]

        if not some.any():
            return n, n, n
        first, second = (n + 1) // 2, n // 2 + 1
        median2 = ranked(first) + ranked(second)
        doubled = 2 * self.values

        def near(y: np.ndarray) -> np.ndarray:
            """How many values of a window are within y of its median, both doubled."""
            return below(np.searchsorted(doubled, median2 + y, "right")) - below(np.searchsorted(doubled, median2 - y))

        def distance(k: np.ndarray, least: np.ndarray) -> np.ndarray:
            """The k-th smallest distance from the median, known to be ``least`` or more: a growing step, then bisection."""
            a, step = least.copy(), 64
            b = a
            short = some & (near(b) < k)
            while short.any():
                a, b = np.where(short, b + 1, a), np.where(short, b + step, b)
                step *= 4
                short = some & (near(b) < k)
            while (a < b).any():
                m = (a + b) // 2
                enough = near(m) >= k
                a, b = np.where(enough | ~some, a, m + 1), np.where(enough | ~some, m, b)
            return b

        closer = distance(first, np.zeros(len(n), dtype=np.int64))
        return n, median2, closer + distance(second, closer)


def _roll(window: int):
    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        own, filled, timed = (rows[c].to_numpy(bool) for c in ("own", "filled", "timed"))
        at, value = rows["us"].to_numpy(np.int64), rows["cents"].to_numpy(np.int64)
        us, cents = at[timed & filled], value[timed & filled]
        order = np.argsort(us, kind="stable")
        runs = Runs(us[order], cents[order], value[~timed], rows["weight"].to_numpy(np.int64)[~timed])
        ends, which = np.unique(at[own], return_inverse=True)
        n, median2, mad4 = (np.zeros(len(ends), dtype=np.int64) for _ in range(3))
        for part, *found in runs.windows(ends, window):
            n[part], median2[part], mad4[part] = found
        n, median2, mad4 = n[which], median2[which], mad4[which]
        far = 2 * np.abs(2 * value[own] - median2) > 3 * mad4
        enough = n >= 2
        columns = {
            "click_id": rows["click_id"].to_numpy(np.int64)[own], "series": rows["series"].to_numpy()[own], "n": n,
            "median2": pd.arrays.IntegerArray(median2, ~enough), "mad4": pd.arrays.IntegerArray(mad4, ~enough), "far": pd.arrays.BooleanArray(far, ~(enough & filled[own])),
        }
        return pd.DataFrame(columns)

    return roll


def rolling_median(
    clicks: DataFrame, *, id_col: str = "click_id", time_col: str = "ts", series_col: str = "kind", value_col: str = "value", window: int = 60 * MINUTE, widths: tuple[int, ...] = WIDTHS, slice_clicks: int = SLICE_CLICKS
) -> DataFrame:
    """One row per click: ``click_id, <series>, n, median2, mad4, far`` over the series' values in (ts - window, ts].

    Values are whole cents, medians doubled, so that every result is an exact
    integer. A series is cut into slices of time; a task holds a slice and
    the window before it, never a series. A slice with more than
    ``slice_clicks`` clicks is cut into slices of the next width; there the
    part of the window that every click of a slice shares comes as counts by
    value, made before it is dealt out. The last width is not cut any further.

    A repeated id counts once: of its rows, the one with the smallest time,
    then series, then cents. Rows without an id or a time are left out. A null
    series is a series. A value that is null, not finite or of 10^15 and more
    has no cents; its click has a row with ``far`` null. With fewer than two
    values ``median2``, ``mad4`` and ``far`` are null. Ties in time share a
    window; equal cents all count. An empty table gives no rows; other columns
    are not read.
    """
    if any(a % b for a, b in zip(widths, widths[1:], strict=False)) or any(w < window and window % w for w in widths):
        raise ValueError("each width must divide the one before, and the window if it is shorter")
    value = F.col(value_col).cast("double")
    cents = F.when(F.abs(value) < 1e15, F.floor(value * 100 + 0.5))
    series = F.when(F.col(series_col).isNotNull(), F.concat(F.lit("="), F.col(series_col).cast("string"))).otherwise("")
    kind = dict(clicks.dtypes)[time_col]
    rows = clicks.select(F.col(id_col).cast("long").alias("click_id"), F.struct(microseconds(F.col(time_col), kind).alias("us"), series.alias("series"), cents.alias("cents")).alias("x"))
    once = rows.where("click_id is not null and x.us is not null").groupBy("click_id").agg(F.min("x").alias("x")).select("click_id", "x.*")
    once = materialize(once.withColumns({"filled": F.col("cents").isNotNull(), "cents": F.coalesce("cents", F.lit(0).cast("long")), "inner": F.lit(True)}), "clicks")
    parts, rest = [], once
    for depth, width in enumerate(widths):
        rest = rest.withColumn("slice", F.expr(f"(us - pmod(us, {width})) div {width}"))
        slices = rest.where("inner").groupBy("series", "slice").agg(F.count(F.lit(1)).alias("clicks"))
        if depth + 1 == len(widths):
            crowded = None
        else:
            crowded = materialize(slices.where(F.col("clicks") > slice_clicks).select("series", "slice"), "crowded")
            if crowded.isEmpty():
                discard(crowded)
                crowded = None
        parts.append(_dealt(rest, width, window, crowded, depth).groupBy("series", "slice").applyInPandas(_roll(window), OUT))
        if crowded is None:
            break
        # What the next width works on: clicks of crowded slices, and those up to a window before them.
        before = -(-window // width)
        reach = crowded.select("series", F.explode(F.sequence(F.col("slice") - before, F.col("slice"))).alias("slice")).distinct()
        inner = rest.where("inner").join(crowded, ["series", "slice"], "left_semi")
        outer = rest.join(reach, ["series", "slice"], "left_semi").join(crowded, ["series", "slice"], "left_anti").withColumn("inner", F.lit(False))
        rest = materialize(inner.unionByName(outer).drop("slice"), "crowded-clicks")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    named = F.when(F.col("series") != "", F.expr("substring(series, 2)")).cast(dict(clicks.dtypes)[series_col])
    return out.select("click_id", named.alias(series_col), "n", "median2", "mad4", "far")


def _dealt(rows: DataFrame, width: int, window: int, crowded: DataFrame | None, depth: int) -> DataFrame:
    """Every slice's own clicks, the values of its windows' edges, and those all its windows share as counts.

    A slice [a, a + width) has windows that begin from a - window on. With a
    width over the window there is no shared part: values up to a window
    before the slice are edge values. Otherwise those from a - window + width
    to a are in every window.
    """
    columns = ("series", "slice", "own", "click_id", "us", "timed", "cents", "filled", "weight")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    own = rows.where("inner").withColumns({"own": F.lit(True), "timed": F.lit(True), "weight": one})
    if crowded is not None:
        own = own.join(crowded, ["series", "slice"], "left_anti")
    values = rows.where("filled").withColumns({"own": F.lit(False), "timed": F.lit(True), "weight": one})
    if width > window:
        late = values.where(F.pmod("us", F.lit(width)) >= width - window)
        edge, shared = late.withColumn("slice", F.col("slice") + 1), None
    else:
        steps = window // width
        edge = values.withColumn("slice", F.col("slice") + steps)
        ahead = values.select("series", F.col("slice").alias("pane"), "cents").groupBy("series", "pane", "cents").agg(F.count(F.lit(1)).alias("weight"))
        ahead = ahead.select("series", F.explode(F.sequence(F.col("pane") + 1, F.col("pane") + (steps - 1))).alias("slice"), "cents", "weight") if steps > 1 else None
        shared = ahead and ahead.groupBy("series", "slice", "cents").agg(F.sum("weight").alias("weight"))
    if depth or crowded is not None:
        # Edge clicks only where a slice of this width has clicks of its own; at the first width every slice next to another is one to a task at most anyway.
        wanted = own.select("series", "slice").distinct()
        edge = edge.join(wanted, ["series", "slice"], "left_semi")
        shared = shared and shared.join(wanted, ["series", "slice"], "left_semi")
    inside = own.unionByName(edge).select(*columns)
    if shared is None:
        return inside
    untimed = {"own": F.lit(False), "timed": F.lit(False), "click_id": none, "us": none, "filled": F.lit(True)}
    return inside.unionByName(shared.withColumns(untimed).select(*columns))
