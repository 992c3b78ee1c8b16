"""Exact inner products of a query set with every row: blocks of queries meet blocks of items, only what can count leaves a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.fusion import ranked
from tessera.sources.workspace import materialize

ITEMS_BLOCK, QUERIES_BLOCK = 4_096, 4_096  # items and queries that one task compares
STRIPE, GROUPS = 65_536, 64  # items of a block worked through tile by tile, and how many blocks are wanted before they grow to that
STEP, TILE = 256, 1_024  # queries, and items of a stripe, whose scores are in memory at once
PAIRS = 1 << 11  # pairs whose vectors are laid side by side at once
CLOSE = 1 << 20  # pairs too close to tell that are looked at together


def met(queries: DataFrame, items: DataFrame, work: Callable, schema: str, *, by: tuple[str, ...] = (), items_block: int = ITEMS_BLOCK, queries_block: int = QUERIES_BLOCK) -> DataFrame:
    """``work(queries, items)`` on every block of queries with every block of items (Arrow tables), or those of equal ``by``.

    Both tables have an id first and a vector ``v``; the blocks are dealt out by
    hash. An item is sent once for each block of queries, a query once for each
    block of items; neither side is broadcast or passes the driver. Blocks of
    items wider than ``ITEMS_BLOCK`` are narrowed while there are under ``GROUPS`` tasks.
    """
    sizes = [df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for df in (queries, items)]
    q_blocks = max(-(-sizes[0] // queries_block), 1)
    items_block = min(items_block, max(-(-sizes[1] * q_blocks // GROUPS), ITEMS_BLOCK))
    i_blocks = max(-(-sizes[1] // items_block), 1)
    whole = F.when(~F.exists("v", lambda x: x.isNull()), F.col("v"))
    deal = lambda df, n: F.pmod(F.xxhash64(df.columns[0], "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", deal(queries, q_blocks)).withColumn("_i", every(i_blocks)).withColumn("v", whole)
    right = items.withColumn("_i", deal(items, i_blocks)).withColumn("_q", every(q_blocks)).withColumn("v", whole)
    keys = (*by, "_q", "_i")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles (n, widest), and the width of each; -1 for none."""
    v = table.column("v").combine_chunks()
    width = np.where(np.asarray(v.is_null()), -1, v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    out = np.zeros((len(v), max(int(width.max(initial=0)), 1)))
    flat = v.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return out, width


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def _slack(q: np.ndarray, v: np.ndarray) -> float:
    """By how much fast products may differ in order from exact ones rounded to nine decimals."""
    with np.errstate(over="ignore"):
        most = [np.sqrt((x[np.isfinite(x).all(axis=1)] ** 2).sum(axis=1)).max(initial=0.0) for x in (q, v)]
    return 2.1e-9 + 1e-12 * most[0] * most[1]


def _scores(q: np.ndarray, v: np.ndarray, wq: np.ndarray, wv: np.ndarray) -> np.ndarray:
    """Fast products; NaN counts as the largest, pairs without a product as the smallest."""
    with np.errstate(all="ignore"):
        s = q @ v.T
    s[np.isnan(s)] = np.inf
    if len(wq) and len(wv) and ((wq != wq[0]).any() or (wv != wq[0]).any() or wq[0] < 0):
        s[(wq[:, None] != wv[None, :]) | (wq[:, None] < 0)] = -np.inf
    return s


def _exact(q: np.ndarray, v: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Products of pairs, added up component by component as ``numbers.dot`` does."""
    out = np.zeros(len(at))
    with np.errstate(all="ignore"):
        for a in range(0, len(at), PAIRS):
            for x in np.ascontiguousarray((q[at[a : a + PAIRS]] * v[to[a : a + PAIRS]]).T):
                out[a : a + PAIRS] += x
    return out


def _nine(x: np.ndarray) -> np.ndarray:
    """Rounded to nine decimals, half up on the shortest decimal form, as Spark rounds."""
    u, where = np.unique(x, return_inverse=True)
    one = Decimal("1e-9")
    return np.array([float(Decimal(repr(float(a))).quantize(one, ROUND_HALF_UP)) if np.isfinite(a) and abs(a) < 1e15 else a for a in u])[where]


def _steps(queries: pa.Table, items: pa.Table) -> Iterator[tuple]:
    """(places of queries, their vectors, item vectors, widths of both, fast scores) of some queries at a time."""
    (q, wq), (v, wv) = _vectors(queries), _vectors(items)
    q, v = _widened(q, v)
    for a in range(0, len(q), STEP):
        at = np.arange(a, min(a + STEP, len(q)))
        yield at, q[at], v, wq[at], wv, _scores(q[at], v, wq[at], wv)


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)


def _halves(q: np.ndarray, v: np.ndarray, of: np.ndarray, to: np.ndarray) -> Iterator[tuple]:
    """Queries ``of`` and items ``to`` of one width in parts, each with the numbers to multiply fast and by how much those differ from exact ones.

    Finite vectors of moderate length are multiplied in single precision; the
    slack is twice the error that its rounding can make. Others stay doubles.
    """
    with np.errstate(all="ignore"):
        long_q, long_v = np.sqrt((q[of] ** 2).sum(axis=1)), np.sqrt((v[to] ** 2).sum(axis=1))
    fine_q, fine_v = long_q < 1e15, long_v < 1e15
    if fine_q.any() and fine_v.any():
        error = (q.shape[1] + 4) * 2.0**-24 * long_v[fine_v].max()
        yield of[fine_q], to[fine_v], np.float32, 2.1e-9 + 2 * error * long_q[fine_q]
    for a, b in ((of[fine_q], to[~fine_v]), (of[~fine_q], to)):
        if len(a) and len(b):
            yield a, b, np.float64, np.full(len(a), _slack(q[a], v[b]))


def _tiles(q: np.ndarray, v: np.ndarray, kind: type) -> Iterator[tuple]:
    """(place of the first item, fast scores) of a step of queries with one tile of items after the other; NaN counts as the largest."""
    q = q.astype(kind)
    for a in range(0, len(v), TILE):
        with np.errstate(all="ignore"):
            s = q @ v[a : a + TILE].T
        if kind is np.float64:
            s[np.isnan(s)] = np.inf
        yield a, s


def _under(score: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """What fast scores must reach; anything does where the slack has no bound."""
    with np.errstate(invalid="ignore"):
        return np.fmax(score - slack, -np.inf)


def _lowered(least: np.ndarray, kind: type) -> np.ndarray:
    """``least`` in the kind of the fast scores, never above it."""
    return least if kind is np.float64 else np.nextafter(least.astype(np.float32), np.float32(-np.inf))


def _reaching(s: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the scores that reach the least of their row."""
    rows = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= least)
    a, b = np.divmod(np.flatnonzero(s[rows] >= least[rows][:, None]), s.shape[1])
    return rows[a], b


def _first_pairs(q: np.ndarray, v: np.ndarray, wq: np.ndarray, wv: np.ndarray, ids: np.ndarray, of: np.ndarray, to: np.ndarray, k: int) -> Iterator[tuple]:
    """Pairs (query, item, score, null) of queries ``of`` and items ``to`` that hold the first ``k`` items of each query.

    A step of queries goes through the items tile by tile and keeps its first
    ``k`` so far: a score that does not reach the last of them is left at once.
    Pairs without a product come last, by item.
    """
    for width in np.unique(wq[of]):
        mine = of[wq[of] == width]
        fits = (wv[to] == width) & (width >= 0)
        rest = to[~fits]
        rest = rest[np.argsort(ids[rest], kind="stable")[:k]]
        if len(rest):
            yield np.repeat(mine, len(rest)), np.tile(rest, len(mine)), np.zeros(len(mine) * len(rest)), np.ones(len(mine) * len(rest), bool)
        for asked, rows, kind, slack in _halves(q, v, mine, to[fits]):
            fast = v[rows].astype(kind)
            for step in range(0, len(asked), STEP):
                line, by = asked[step : step + STEP], slack[step : step + STEP]
                least = np.full(len(line), -np.inf)
                a, b, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                new, waits, due = [], 0, 0
                for at, s in _tiles(q[line], fast, kind):
                    if at == 0:
                        least = _under(_kth(s, k), by)
                    x, y = _reaching(s, _lowered(least, kind))
                    new.append((x, y + at))
                    waits += len(x)
                    if at >= due or waits > CLOSE or at + TILE >= len(rows):
                        due = 4 * at + TILE
                        x, y = (np.concatenate(c) for c in zip(*new, strict=True))
                        a, b, score = np.r_[a, x], np.r_[b, y], np.r_[score, _exact(q, v, line[x], rows[y])]
                        new, waits = [], 0
                        rank_by = np.where(np.isnan(score), np.inf, score)
                        order = np.lexsort((ids[rows[b]], ~np.isnan(score), -rank_by, a))
                        a, b, score, rank_by = a[order], b[order], score[order], rank_by[order]
                        first = first_rows(a, rank_by, np.zeros(len(a), bool), k)
                        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
                        full = start[np.diff(np.append(start, len(a))) >= k]
                        least[a[full]] = _under(rank_by[full + k - 1], by[a[full]])
                        a, b, score = a[first], b[first], score[first]
                yield line[a], rows[b], score, np.zeros(len(a), bool)


def first_rows(q: np.ndarray, score: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Of rows in order, the first ``k`` of each query and those that rounding may set before one of them."""
    n = np.arange(len(q))
    begin = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], n, 0))
    value = np.maximum.accumulate(np.where(np.r_[True, (q[1:] != q[:-1]) | (null[1:] != null[:-1]) | (score[1:] != score[:-1])], n, 0))
    last = np.minimum(begin + k - 1, len(q) - 1)
    near = ~null & ~null[last] & (score >= score[last] - 2.1e-9) & (n - value < k) & (q[last] == q)
    return (n - begin < k) | near


BEST = "query long, asked long, item long, label long, score double"


def _copies(v: np.ndarray, wv: np.ndarray, label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sets equal vectors of one label side by side, by id, and where each group of them begins."""
    key = np.column_stack([v.view(np.int64), wv, label])
    factor = np.random.default_rng(0).integers(1, 2**62, key.shape[1]) * 2 + 1
    order = np.lexsort((ids, (key * factor).sum(axis=1)))
    return order, np.flatnonzero(np.r_[True, (key[order[1:]] != key[order[:-1]]).any(axis=1)])


def _in_order(ids: np.ndarray, a: np.ndarray, item: np.ndarray, score: np.ndarray, null: np.ndarray) -> list[np.ndarray]:
    line = np.lexsort((ids[item], ~np.isnan(score), -np.where(np.isnan(score), np.inf, score), null, a))
    return [x[line] for x in (a, item, score, null)]


def _firsts(a: np.ndarray, score: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    return first_rows(a, np.where(np.isnan(score), np.inf, score), null, k) if len(a) else np.zeros(0, bool)


def _best(k: int, same: bool, others: bool) -> Callable:
    def work(queries: pa.Table, items: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)]]
        if queries.num_rows and items.num_rows:
            ids, asked_ids = _ids(items, "item"), _ids(queries, "query")
            label, asked, none = _ids(items, "label"), _ids(queries, "asked"), np.iinfo(np.int64).min
            # Copies of a vector with one label score alike: each is scored once, and at most k + 1 of them can count.
            (q, wq), (v, wv) = _vectors(queries), _vectors(items)
            order, start = _copies(v, wv, label, ids)
            size = np.minimum(np.diff(np.append(start, len(order))), k + 1)
            q, v = _widened(q, v[order[start]])
            wv, by_label, lead = wv[order[start]], label[order[start]], ids[order[start]]
            parts = [(np.arange(len(q)), np.arange(len(v)))]
            if same:
                held = np.argsort(by_label, kind="stable")
                ends = lambda x: (np.searchsorted(by_label[held], x), np.searchsorted(by_label[held], x, side="right"))
                parts += [(np.flatnonzero(asked == x), held[slice(*ends(x))]) for x in np.intersect1d(asked[asked != none], by_label)]
            for of, to in parts:
                for a, b, score, null in _first_pairs(q, v, wq, wv, lead, of, to, k + 1):
                    n = size[b]
                    item = order[np.repeat(start[b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    a, score, null = np.repeat(a, n), np.repeat(score, n), np.repeat(null, n)
                    other = ids[item] != asked_ids[a] if others else np.ones(len(a), bool)
                    rows = _in_order(ids, a[other], item[other], score[other], null[other])
                    first = _firsts(rows[0], *rows[2:], k)
                    found.append([x[first] for x in rows])
        a, item, score, null = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(a):
            line = np.lexsort((item, a))  # a pair may come twice: as one of all items and as one of its label
            line = line[np.r_[True, (a[line][1:] != a[line][:-1]) | (item[line][1:] != item[line][:-1])]]
            a, item, score, null = _in_order(ids, a[line], item[line], score[line], null[line])
            first = _firsts(a, score, null, k)
            if same:
                hit = np.flatnonzero((label[item] == asked[a]) & (label[item] != none))
                first[hit[_firsts(a[hit], score[hit], null[hit], k)]] = True
            a, item, score, null = a[first], item[first], score[first], null[first]
        columns = [queries.column("query").take(pa.array(a)), queries.column("asked").take(pa.array(a)), items.column("item").take(pa.array(item)), items.column("label").take(pa.array(item))]
        return pa.Table.from_arrays([*(c.cast(pa.int64()) for c in columns), pa.array(score, mask=null)], names=["query", "asked", "item", "label", "score"])

    return work


def best_products(queries: DataFrame, items: DataFrame, k: int, *, same: bool = False, others: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``(query, asked, item, label, score, rank)``: the ``k`` best items of each query (query, asked, v) among items (item, label, v).

    Ranks are those over all items, by score to nine decimals, then item;
    ``others`` leaves the query's own row out. With ``same``, the ``k`` best
    items of the label asked for come as well, with a null rank beyond ``k``.
    Fast products only choose what is scored exactly, so the order is that of
    ``numbers.dot``. A task sends its own best rows of a query.
    """
    asked = queries if "asked" in queries.columns else queries.withColumn("asked", F.lit(None).cast("long"))
    rows = items if "label" in items.columns else items.withColumn("label", F.lit(None).cast("long"))
    left = asked.select(F.col("query").cast("long").alias("query"), F.col("asked").cast("long").alias("asked"), "v", *by)
    right = rows.select(F.col("item").cast("long").alias("item"), F.col("label").cast("long").alias("label"), "v", *by)
    near = met(left, right, _best(k, same, others), BEST, by=by, items_block=STRIPE)
    if not same:
        return near.withColumn("rank", ranked("score")).where(F.col("rank") <= k)
    placed = near.withColumn("rank", ranked("score"))
    hit = F.col("label") == F.col("asked")
    placed = placed.withColumn("_same", F.when(hit, F.sum(hit.cast("int")).over(_order())))
    return placed.where((F.col("rank") <= k) | (F.col("_same") <= k)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("_same")


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "item").rowsBetween(Window.unboundedPreceding, 0)


def _before(queries: pa.Table, items: pa.Table) -> pa.Table:
    """How many items of the block stand before each target (score, item) of a query, where any does.

    Only items that reach a query's lowest target are looked at, tile by tile:
    one sort of those and of all targets counts who is surely before, those too
    close to tell are scored exactly.
    """
    ids, asked_ids, targets = _ids(items, "item"), _ids(queries, "query"), queries.column("targets").combine_chunks()
    of = np.repeat(np.arange(len(targets)), targets.value_lengths().to_numpy(zero_copy_only=False))
    score, item = targets.flatten().flatten()
    none, key, item = np.asarray(score.is_null()), score.fill_null(0.0).to_numpy(zero_copy_only=False), item.to_numpy(zero_copy_only=False)
    n = np.zeros(len(of), np.int64)
    if queries.num_rows and items.num_rows:
        (q, wq), (v, wv) = _vectors(queries), _vectors(items)
        q, v = _widened(q, v)
        for width in np.unique(wq[wq >= 0]):
            for asked, rows, kind, slack in _halves(q, v, np.flatnonzero(wq == width), np.flatnonzero(wv == width)):
                fast, mine = v[rows].astype(kind), ids[rows]
                for step in range(0, len(asked), STEP):
                    line, by = asked[step : step + STEP], slack[step : step + STEP]
                    at_row = np.full(len(q), -1)
                    at_row[line] = np.arange(len(line))
                    t = np.flatnonzero((at_row[of] >= 0) & ~none)
                    row, low = at_row[of[t]], np.full(len(line), np.inf)
                    np.minimum.at(low, row, np.where(np.isnan(key[t]), np.inf, key[t]))
                    found, waits = [], 0
                    for at, scores in _tiles(q[line], fast, kind):
                        a, b = _reaching(scores, _lowered(_under(low, by), kind))
                        other = mine[at + b] != asked_ids[line[a]]
                        a, b = a[other], b[other]
                        found.append((a, at + b, scores[a, b].astype(np.float64)))
                        waits += len(a)
                        if waits > CLOSE or at + TILE >= len(rows):
                            a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
                            n[t] += _passed(a, s, row, key[t], by[row], item[t], lambda a, b, line=line, rows=rows: _exact(q, v, line[a], rows[b]), b, mine)
                            found, waits = [], 0
        for j in np.flatnonzero(none).tolist():
            fits = (wq[of[j]] == wv) & (wq[of[j]] >= 0)
            n[j] = int(((ids != asked_ids[of[j]]) & (fits | (ids < item[j]))).sum())
    some = n > 0
    return pa.table({"query": pa.array(asked_ids[of[some]], pa.int64()), "item": pa.array(item[some], pa.int64()), "n": pa.array(n[some], pa.int64())})


def _passed(a: np.ndarray, s: np.ndarray, row: np.ndarray, key: np.ndarray, slack: np.ndarray, item: np.ndarray, exact: Callable, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each target (row, key, item), how many of the items ``b`` of its row stand before it: fast scores ``s``, exact ones only where those are too close."""
    line = np.lexsort((s, a))
    a, b, s = a[line], b[line], s[line]
    nan, high = np.isnan(key), np.where(np.isnan(key), np.inf, key)
    kind = np.repeat([1, 2, 0], [len(a), len(row), len(row)])
    line = np.lexsort((kind, np.r_[s, -_under(-high, slack), _under(high, slack)], np.r_[a, row, row]))
    place = np.empty(len(line), np.int64)
    place[line] = np.cumsum(kind[line] == 1)
    sure, close = place[kind == 2], place[kind == 0]  # where the items of each target begin that are surely, maybe before it
    n, many = np.searchsorted(a, row, side="right") - sure, sure - close
    own = np.zeros(len(row))
    own[many > 0] = _nine(high[many > 0])
    for group in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(many) // CLOSE)) + 1):
        g = np.repeat(group, many[group])
        c = np.repeat(close[group] - np.cumsum(many[group]) + many[group], many[group]) + np.arange(len(g))
        if len(c):
            x = exact(a[c], b[c])
            r, over = _nine(np.where(np.isnan(x), np.inf, x)), np.isnan(x)
            before = (over & ~nan[g]) | ((over == nan[g]) & ((r > own[g]) | ((r == own[g]) & (ids[b[c]] < item[g]))))
            n += np.bincount(g[before], minlength=len(row))
    return n


def same_ranks(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``best_products`` with ``same``, the ranks beyond ``k`` filled in: those rows' predecessors are counted block by block."""
    best = materialize(best_products(queries, items, k, same=True), "best")
    far = best.where("rank is null")
    if far.isEmpty():
        return best
    targets = far.groupBy("query").agg(F.collect_list(F.struct("score", "item")).alias("targets"))
    left = queries.select(F.col("query").cast("long").alias("query"), "v").join(targets, "query")
    counted = met(left.select("query", "v", "targets"), items.select(F.col("item").cast("long").alias("item"), "v"), _before, "query long, item long, n long", items_block=STRIPE)
    places = counted.groupBy("query", "item").agg((F.sum("n") + 1).alias("_place"))
    return best.join(places, ["query", "item"], "left").withColumn("rank", F.coalesce(F.col("rank").cast("long"), "_place")).drop("_place")


def near_products(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(query, item, score)`` of all other items (item, v) whose score reaches the ``cut`` of its query (query, v, cut)."""

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [_pairs_table([], [], [])]
        if asked.num_rows and rows.num_rows:
            ids, asked_ids, cut = _ids(rows, "item"), _ids(asked, "query"), asked.column("cut").to_numpy()
            (q, wq), (v, wv) = _vectors(asked), _vectors(rows)
            q, v = _widened(q, v)
            for width in np.unique(wq[wq >= 0]):
                for of, to, kind, slack in _halves(q, v, np.flatnonzero(wq == width), np.flatnonzero(wv == width)):
                    fast = v[to].astype(kind)
                    for step in range(0, len(of), STEP):
                        line, by = of[step : step + STEP], slack[step : step + STEP]
                        for at, s in _tiles(q[line], fast, kind):
                            a, b = _reaching(s, _lowered(_under(cut[line], by), kind))
                            a, b = line[a], to[at + b]
                            x = _exact(q, v, a, b)
                            keep = ((x >= cut[a]) | np.isnan(x)) & (ids[b] != asked_ids[a])
                            parts.append(_pairs_table(asked_ids[a[keep]], ids[b[keep]], x[keep]))
        return pa.concat_tables(parts)

    left = queries.where("cut is not null").select(F.col("query").cast("long").alias("query"), "v", F.col("cut").cast("double").alias("cut"))
    return met(left, items.where("item is not null").select(F.col("item").cast("long").alias("item"), "v"), work, "query long, item long, score double", queries_block=1_024)


def _pairs_table(query, item, score) -> pa.Table:
    return pa.table({"query": pa.array(query, pa.int64()), "item": pa.array(item, pa.int64()), "score": pa.array(score, pa.float64())})


def scaled_products(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(query, item, scaled)``: products of every query (query, v) and item (item, v) scaled to 0..1 by the extremes of the query.

    One row a pair by definition. Products are made twice, first for the
    extremes and then for the rows: no pair is shuffled, sorted or stored.
    """

    def ends(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            for at, q, v, wq, wv, s in _steps(asked, rows):
                fits = (wq[:, None] == wv[None, :]) & (wq[:, None] >= 0)
                low, high = np.where(fits, s, np.inf).min(axis=1), np.where(fits, s, -np.inf).max(axis=1)
                out.append(pa.table({"query": asked.column("query").take(pa.array(at)), "low": pa.array(low, mask=~fits.any(axis=1)), "high": pa.array(high, mask=~fits.any(axis=1))}))
        return pa.concat_tables([pa.table({"query": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())}), *out])

    def scaled(asked: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [_pairs_table([], [], []).rename_columns(["query", "item", "scaled"])]
        if asked.num_rows and rows.num_rows:
            low, high = (asked.column(c).combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            n = rows.num_rows
            for at, _q, _v, wq, wv, s in _steps(asked, rows):
                with np.errstate(all="ignore"):
                    x = (s - low[at][:, None]) / np.maximum(high[at] - low[at], 1e-8)[:, None]
                none = (wq[:, None] != wv[None, :]) | (wq[:, None] < 0)
                query = asked.column("query").take(pa.array(np.repeat(at, n)))
                parts.append(pa.Table.from_arrays([query, rows.column("item").take(pa.array(np.tile(np.arange(n), len(at)))), pa.array(x.ravel(), mask=none.ravel())], names=["query", "item", "scaled"]))
        return pa.concat_tables(parts)

    left, right = queries.select(F.col("query").cast("long").alias("query"), "v"), items.select(F.col("item").cast("long").alias("item"), "v")
    found = met(left, right, ends, "query long, low double, high double").groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return met(left.join(materialize(found, "ends"), "query"), right, scaled, "query long, item long, scaled double", items_block=1_024, queries_block=1_024)


def best_by_group(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(query, slot, passage, best)``: the largest product of each query vector (slot, query, v) with any vector of each passage (passage, v).

    A block of items sends one row for each of its passages and query vector.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *items.schema.fields)}

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]]
        if asked.num_rows and rows.num_rows:
            code = rows.column("passage").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
            rows = rows.take(pa.array(order))
            for at, _q, _v, wq, wv, s in _steps(asked, rows):
                best, some = np.maximum.reduceat(s, start, axis=1), np.logical_or.reduceat((wq[:, None] == wv[None, :]) & (wq[:, None] >= 0), start, axis=1)
                a, b = np.nonzero(some)
                found.append([at[a], start[b], best[a, b]])
        a, b, best = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_arrays([asked.column("query").take(pa.array(a)), asked.column("slot").take(pa.array(a)), rows.column("passage").take(pa.array(b)), pa.array(best)], names=["query", "slot", "passage", "best"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query", "slot", "passage")) + ", best double"
    near = met(queries.select("slot", "query", "v"), items.select("passage", "v"), work, schema)
    return near.groupBy("query", "slot", "passage").agg(F.max("best").alias("best"))
