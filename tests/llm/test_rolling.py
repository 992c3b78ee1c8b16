"""Rolling median and deviation against a plain version."""

from collections import defaultdict
from datetime import datetime, timedelta
from math import floor, isfinite

import numpy as np
import pytest

from tessera.llm.rolling import MINUTE, Runs, rolling_median

SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, series int, slice string, own int, us string"


def doubled_median(values):
    v = sorted(values)
    return v[(len(v) - 1) // 2] + v[len(v) // 2]


def plain(rows):
    """rows: (click_id, microseconds, kind, value) -> {click_id: result}, straight from the definition."""
    once = {}
    for i, us, kind, value in rows:
        if i is not None and us is not None:
            cents = floor(100 * value + 0.5) if value is not None and isfinite(value) else None
            new = (us, kind is not None, kind or "", cents is not None, cents or 0), (us, kind, cents)
            once[i] = min(once.get(i, new), new)
    series = defaultdict(list)
    for _, (us, kind, cents) in once.values():
        series[kind].append((us, cents))
    out = {}
    for i, (_, (us, kind, cents)) in once.items():
        v = [c for u, c in series[kind] if us - 60 * MINUTE < u <= us and c is not None]
        if len(v) < 2:
            out[i] = (i, kind, len(v), None, None, None)
            continue
        m = doubled_median(v)
        d = doubled_median([abs(2 * c - m) for c in v])
        out[i] = (i, kind, len(v), m, d, None if cents is None else 2 * abs(2 * cents - m) > 3 * d)
    return out


def frame(spark, rows):
    start = datetime(1970, 1, 1)
    return spark.createDataFrame([(i, None if us is None else start + timedelta(microseconds=us), k, v, 1, "s", 2, "u") for i, us, k, v in rows], SCHEMA)


def made(seed, n, minutes, tie=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        us = int(rng.integers(-90 * MINUTE, minutes * MINUTE)) // tie * tie
        kind = [None, "", "a", "a", "a", "="][rng.integers(6)]
        value = None if rng.random() < 0.05 else float(np.round(rng.lognormal(3, 1.5) - 5, 2))
        rows.append((i, us, kind, value))
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("limit", "tie"), [(10**9, 1), (40, 1), (1, 20 * MINUTE), (5, 7 * MINUTE)])
def test_rolling_median(spark, limit, tie):
    rows = made(limit % 7, 500, 400, tie)
    rows += [(1000, None, "a", 1.0), (None, 5, "a", 1.0), (1001, 7, "a", float("nan")), (1002, 7, "a", float("inf")), (1003, 8, "lone", 2.0), (1004, 9, "empty", None)]
    rows += [(1005, 60 * MINUTE, "edge", 1.0), (1006, 120 * MINUTE, "edge", 2.0), (1007, 120 * MINUTE - 1, "edge", 3.0), (1008, 9, "a", 4.0), (1008, 3, "a", 5.0)]
    got = [tuple(r) for r in rolling_median(frame(spark, rows), slice_clicks=limit).collect()]
    assert len(got) == len({r[0] for r in got}) and {r[0]: r for r in got} == plain(rows)


def test_one_moment_holds_all(spark):
    rows = [(i, 5, "a", float(i % 9)) for i in range(300)]
    for limit in (10**9, 10):
        assert {r[0]: tuple(r) for r in rolling_median(frame(spark, rows), slice_clicks=limit).collect()} == plain(rows)


def test_empty_table(spark):
    assert rolling_median(frame(spark, [])).columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    assert rolling_median(frame(spark, [])).collect() == []


def test_zone_of_the_session_does_not_matter(spark):
    rows = made(3, 200, 60 * 24 * 90)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {r[0]: tuple(r) for r in rolling_median(frame(spark, rows)).collect()} == plain(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_widths_must_fit(spark):
    with pytest.raises(ValueError):
        rolling_median(frame(spark, []), widths=(7 * MINUTE, 2 * MINUTE))


def test_blocks_of_edge_values_and_shared_counts(monkeypatch):
    from tessera.llm import rolling

    monkeypatch.setattr(rolling, "EDGE_VALUES", 50)
    rng = np.random.default_rng(5)
    us, cents = np.sort(rng.integers(0, 1000, 400)), rng.integers(-50, 50, 400)
    shared, weight = np.array([-3, 7, 7]), np.array([5, 1, 2])
    runs, ends = Runs(us, cents, shared, weight), np.unique(us)
    n, median2, mad4 = (np.zeros(len(ends), dtype=np.int64) for _ in range(3))
    for part, *found in runs.windows(ends, 100):
        n[part], median2[part], mad4[part] = found
    for i, t in enumerate(ends):
        v = [*cents[(us > t - 100) & (us <= t)].tolist(), *np.repeat(shared, weight).tolist()]
        m = doubled_median(v)
        assert (n[i], median2[i], mad4[i]) == (len(v), m, doubled_median([abs(2 * c - m) for c in v]))
