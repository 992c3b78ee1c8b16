"""Block products: the same rows as a plain comparison of all pairs, which no plan makes."""

import random

import pytest

from tessera.plans import catalogue

SEARCHES = "q05_dense_knn_top10 q07_minmax_normalise q12_maxsim q28_ir_metrics q29_gated_metrics q30_open_set_gate q31_acceptance_table q32_discovery_cutoff q34_coverage q44_review_priority q49_transition_counts q58_guarded_admission q72_promoted_evidence q73_union_recall q113_retrieval_errors q143_ranking_signatures q150_entity_policy q151_discovery_filtered q163_preferred_branch q179_inverted_index"


@pytest.mark.parametrize("name", SEARCHES.split())
def test_no_pair_of_query_and_item_is_a_row_of_a_join(spark, small, name):
    from tessera.plans import evaluation

    rows = catalogue.QUERIES[name](spark, small) if name != "q179_inverted_index" else evaluation._ranked(spark, small, 10)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan or name in ("q28_ir_metrics",)  # one row with one row
    assert "CartesianProduct" not in plan


def _rows(spark):
    rng = random.Random(5)
    base = [[rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(40)]
    rows = [(i, base[i % 40] if i % 37 else None, rng.choice([0, 1, 2, None])) for i in range(400)]
    return rows, spark.createDataFrame(rows, "item long, v array<float>, label int")


def _plain(rows):
    out = {}
    for q, a, asked in rows:
        if q % 10 == 0:
            scored = [(None if a is None or b is None else sum(x * y for x, y in zip(a, b, strict=True)), i, label) for i, b, label in rows if i != q]
            scored.sort(key=lambda r: (r[0] is None, -round(r[0] or 0.0, 9), r[1]))
            out[q] = asked, [(i, label, s) for s, i, label in scored]
    return out


@pytest.mark.parametrize("k", [1, 7])
def test_ranks_with_ties_copies_and_nulls(spark, monkeypatch, k):
    from tessera.operators import products

    monkeypatch.setattr(products, "met", lambda q, i, w, s, by=(), real=products.met, **_: real(q, i, w, s, by=by, items_block=90, queries_block=25))
    rows, items = _rows(spark)
    queries = items.where("item % 10 = 0").selectExpr("item as query", "label as asked", "v")
    want = _plain(rows)
    got = {(r.query, r.rank): (r.item, r.label, r.score) for r in products.best_products(queries, items, k).collect()}
    assert got == {(q, n): r for q, (_, line) in want.items() for n, r in enumerate(line[:k], 1)}
    same = {(r.query, r.item): r["rank"] for r in products.same_ranks(queries, items, k).collect()}
    keep = {}
    for q, (asked, line) in want.items():
        hits = [n for n, r in enumerate(line) if asked is not None and r[1] == asked][:k]
        keep.update({(q, line[n][0]): n + 1 for n in {*range(k), *hits}})
    assert same == keep


def test_near_scaled_and_neighbours(spark):
    from tessera.operators import ordering, products

    rows, items = _rows(spark)
    queries = items.where("item % 10 = 0").selectExpr("item as query", "v", "0.5D as cut")
    want = _plain(rows)
    assert sorted((r.query, r.item) for r in products.near_products(queries, items).collect()) == sorted((q, i) for q, (_, line) in want.items() for i, _, s in line if s is not None and s >= 0.5)
    scaled = products.scaled_products(queries.drop("cut"), items.drop("label")).collect()
    assert len(scaled) == 40 * 400 and all(r.scaled is None or 0 <= r.scaled <= 1 for r in scaled)
    near = ordering.neighbours(queries.select("query"), items.select("item"), 2).collect()
    assert sorted(r.item for r in near if r.query == 0) == [1, 2] and sorted(r.item for r in near if r.query == 50) == [48, 49, 51, 52]


def test_blocks_without_predecessors_send_nothing():
    """A block of items answers for the targets that it holds a predecessor of, not for every target of every query."""
    import numpy as np
    import pyarrow as pa

    from tessera.operators import products

    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 4)), 1)
    scores = np.round(v[:20] @ v.T, 9)
    asked = [[{"score": float(scores[q, i]), "item": i} for i in (q + 1, 150 + q, 299 - q)] for q in range(20)]
    kind = pa.list_(pa.struct([("score", pa.float64()), ("item", pa.int64())]))
    queries = pa.table({"query": pa.array(range(20), pa.int64()), "v": pa.array(v[:20].tolist()), "targets": pa.array(asked, kind)})
    total, sent = {}, 0
    for a in range(0, 300, 10):
        items = pa.table({"item": pa.array(range(a, a + 10), pa.int64()), "v": pa.array(v[a : a + 10].tolist())})
        for r in products._before(queries, items).to_pylist():
            assert r["n"] > 0
            total[r["query"], r["item"]] = total.get((r["query"], r["item"]), 0) + r["n"]
            sent += 1
    want = {}
    for q in range(20):
        for t in asked[q]:
            n = sum(i != q and (scores[q, i] > scores[q, t["item"]] or (scores[q, i] == scores[q, t["item"]] and i < t["item"])) for i in range(300))
            want.update({(q, t["item"]): n} if n else {})
    assert total == want and sent < 20 * 3 * 30


def _tables(rows, asked):
    import pyarrow as pa

    v = pa.list_(pa.float64())
    items = pa.table({"item": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[2] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], v)})
    queries = pa.table({"query": pa.array([r[0] for r in asked], pa.int64()), "asked": pa.array([r[2] for r in asked], pa.int64()), "v": pa.array([r[1] for r in asked], v)})
    return queries, items


def _odd(monkeypatch):
    """Null, empty, short, endless and very long vectors, NaN, copies and ties, in tiles far smaller than the block; each query's items in order."""
    from tessera.operators import products

    for name, n in (("STEP", 7), ("TILE", 16), ("CLOSE", 200), ("PAIRS", 32)):
        monkeypatch.setattr(products, name, n, raising=False)
    rng = random.Random(11)
    odd = [None, [], [1.0], [float("nan"), 0.0, 1.0], [float("inf"), 1.0, 1.0], [float("-inf"), 1.0, 0.5], [1e200, 1.0, 0.0], [-1e18, 0.5, 1.0], [1e-42, 0.0, 1e-40]]
    base = [*odd, *([rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(60))]
    rows = [(i, rng.choice(base) if i > 8 else odd[i], rng.choice([0, 1, 2, None])) for i in range(500)]
    asked = [r for r in rows if r[0] < 9 or r[0] % 10 == 0]
    lines = {}
    for q, a, _ in asked:
        line = []
        for i, b, kind in rows:
            s = None if a is None or b is None or len(a) != len(b) else sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
            nan = s is not None and s != s
            line.append(((s is None, not nan, 0.0 if s is None or nan else -round(s, 9), i), i, kind, s))
        lines[q] = [r[1:] for r in sorted(line, key=lambda r: r[0]) if r[1] != q]
    return rows, asked, lines


@pytest.mark.parametrize("same", [False, True])
def test_best_rows_of_a_block_of_odd_vectors(monkeypatch, same):
    from tessera.operators import products

    rows, asked, lines = _odd(monkeypatch)
    found, k = {}, 4
    for r in products._best(k, same, True)(*_tables(rows, asked)).to_pylist():
        assert r["query"] not in found or r["item"] not in found[r["query"]]
        found.setdefault(r["query"], {})[r["item"]] = r["score"]
    for q, _, label in asked:
        line = lines[q]
        want = line[:k] + ([r for r in line if label is not None and r[1] == label][:k] if same else [])
        for i, _, s in want:
            assert i in found[q] and (found[q][i] == s or (s is not None and s != s and found[q][i] != found[q][i]))


def test_scores_of_a_wide_block_are_never_in_memory_together():
    """A block may hold any number of items: it is worked through in tiles and sends ``k`` rows a query, so blocks can be few."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.operators import products

    v = np.random.default_rng(2).normal(size=(40_000, 2))
    items = pa.table({"item": pa.array(range(40_000), pa.int64()), "label": pa.array([0] * 40_000, pa.int64()), "v": pa.array(list(v))})
    queries = pa.table({"query": pa.array(range(256), pa.int64()), "asked": pa.array([0] * 256, pa.int64()), "v": pa.array(list(v[:256]))})
    tracemalloc.start()
    try:
        rows = products._best(3, False, True)(queries, items)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows.num_rows == 256 * 3 and peak < 256 * 40_000 * 4


def test_predecessors_in_a_block_of_odd_vectors(monkeypatch):
    import pyarrow as pa

    from tessera.operators import products

    rows, asked, lines = _odd(monkeypatch)
    queries, items = _tables(rows, asked)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("item", pa.int64())]))
    targets = [[{"score": s, "item": i} for i, _, s in lines[q][::9]] for q, *_ in asked]
    got = {(r["query"], r["item"]): r["n"] for r in products._before(queries.append_column("targets", pa.array(targets, kind)), items.drop_columns("label")).to_pylist()}
    assert got == {(q, i): n for q, line in lines.items() for n, (i, *_) in list(enumerate(line))[9::9]}


def test_only_targets_with_close_items_are_rounded(monkeypatch):
    """Rounding a score is dear: a block must not do it for every target, as each query's targets go to each block of items."""
    import numpy as np
    import pyarrow as pa

    from tessera.operators import products

    rounded = []
    monkeypatch.setattr(products, "_nine", lambda x, real=products._nine: rounded.append(len(x)) or real(x))
    v = np.random.default_rng(3).normal(size=(300, 4))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("item", pa.int64())]))
    asked = [[{"score": -1000.0 + j, "item": 1000 + j} for j in range(30)] for _ in range(20)]
    queries = pa.table({"query": pa.array(range(20), pa.int64()), "v": pa.array(v[:20].tolist()), "targets": pa.array(asked, kind)})
    out = products._before(queries, pa.table({"item": pa.array(range(300), pa.int64()), "v": pa.array(v.tolist())}))
    assert out.num_rows == 600 and set(out.column("n").to_pylist()) == {299} and sum(rounded) == 0


def test_rows_that_reach_a_cut_that_is_no_number(spark):
    """NaN reaches NaN, as in SQL; a finite cut is reached by NaN, infinity and what is large enough."""
    from tessera.operators import products

    nan, inf = float("nan"), float("inf")
    base = [[nan, 1.0], [inf, 1.0], [1.0, 0.5], [0.25, 0.0], [-1.0, 0.0], None, [1.0]]
    items = spark.createDataFrame([(i, base[i % 7]) for i in range(70)], "item long, v array<float>")
    queries = spark.createDataFrame([(1000, [1.0, 1.0], nan), (1001, [1.0, 1.0], inf), (1002, [1.0, 1.0], 0.25), (1003, [nan, 1.0], nan), (30, [1.0, 1.0], 1.5), (1004, None, 0.0)], "query long, v array<float>, cut double")
    got = {}
    for r in products.near_products(queries, items).collect():
        got.setdefault(r["query"], []).append(r["item"])
    kinds = {1000: {0}, 1001: {0, 1}, 1002: {0, 1, 2, 3}, 1003: {0, 1, 2, 3, 4}, 30: {0, 1, 2}}
    assert {q: sorted(x) for q, x in got.items()} == {q: [i for i in range(70) if i % 7 in kind and i != q] for q, kind in kinds.items()}
