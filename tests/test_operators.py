"""Golden cases of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import corpus, fusion, gates, intent, lexical, lifecycle, metrics, splits, statistics, vectors
from tessera.operators.graph import connected_components


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens(spark):
    rows = spark.createDataFrame([("森林 Campus-A1",), ("",), (None,), ("Étion a.b:c/d+e_f",)], "t string").select(text.tokens(F.coalesce("t", F.lit(""))).alias("x")).collect()
    assert rows[0].x == ["森", "林", "森林", "campus-a1"] and rows[1].x == rows[2].x == []
    assert rows[3].x == ["tion", "a.b:c/d+e_f"]


def test_text_forms(spark):
    r = one(
        spark, text.normalized_query(F.lit("  A  b\n")).alias("a"), text.id_list(F.lit("x; y,x;;")).alias("b"), text.quoted_terms(F.lit('"ab" “cd” "e" "ab"')).alias("c"),
        text.sparse_weight(F.lit("ab")).alias("d"), text.sparse_weight(F.lit("abcdefghi")).alias("e"), text.excerpt(F.lit("x" * 300 + "needle" + "y" * 300), F.array(F.lit("needle")), 40).alias("f"),
        text.edge_trimmed(F.lit(" ,a  b. ")).alias("g"), text.normalized_ocr(F.lit("ＡＢ－c_d")).alias("h"),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("a b", ["x", "y"], ["ab", "cd"], 0.05, 0.30)
    assert r.f.startswith("...") and "needle" in r.f and r.f.endswith("...") and (r.g, r.h) == ("a b", "ab c_d")


def test_bm25_unseen_and_top(spark):
    docs = spark.createDataFrame([(1, "red crane"), (2, "blue crane crane"), (3, None)], "i int, t string")
    asked = spark.createDataFrame([(1, "crane"), (2, "unseen")], "q int, t string")
    scores = lexical.bm25(asked, docs, query_id="q", query_col="t", id_col="i", text_col="t")
    best = {(r["query"], r["item"]): r["rank"] for r in lexical.top_k(scores, 5).collect()}
    assert best == {(1, 2): 1, (1, 1): 2}


def test_fusion(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 1.0), ("b", 2, 3.0)], "query string, item int, s double")
    got = rows.select("query", "item", fusion.min_max("s").alias("m"), fusion.rank_percentile("s").alias("p"), fusion.reciprocal_rank("s", top=1).alias("r")).collect()
    assert {(r["query"], r["item"]): (r.m, r.p, r.r) for r in got} == {("a", 1): (0, 1, 1 / 61), ("a", 2): (0, 0, 0), ("b", 1): (0, 0, 0), ("b", 2): (1, 1, 1 / 61)}
    r = one(spark, fusion.adaptive(F.lit(1.0), F.lit(0.4), F.lit(0.0)).alias("x"), fusion.quality_rrf(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(1.0)).alias("y"))
    assert (r.x, r.y) == (0.4, 1.25)


def test_vectors(spark):
    q = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "query string, slot int, v array<double>")
    p = spark.createDataFrame([("p", [0.5, 0.1]), ("p", None), ("r", [0.2, 0.9])], "passage string, v array<double>")
    assert {r.passage: round(r.score, 6) for r in vectors.maxsim(q, p).collect()} == {"p": 0.6, "r": 1.1}
    assert one(spark, numbers.l2_normalized(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).z == [0.0, 0.0]
    rng = random.Random(5)
    hashes = [(i, rng.getrandbits(60)) for i in range(40)]
    hashes += [(100 + i, h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for i, h in hashes]
    want = {(a, b) for a, x in hashes for b, y in hashes if a < b and (x ^ y).bit_count() <= 3}
    got = vectors.near_hashes(spark.createDataFrame(hashes, "item long, h long"), 3)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_sign_hash_counts_every_component(spark):
    rng = random.Random(9)
    base = [rng.choice((-1.0, 1.0)) for _ in range(64)]
    flipped = lambda places: [-x if i in places else x for i, x in enumerate(base)]
    rows = [(0, base), (1, flipped({60, 61, 62, 63})), (2, flipped({0, 1, 2, 60, 61, 63})), (3, flipped({5, 63}))]
    frame = spark.createDataFrame(rows, "item long, v array<double>")
    got = vectors.near_hashes(frame.select("item", vectors.sign_hash(F.col("v")).alias("h")), 5)
    want = {(a, b, n) for a, x in rows for b, y in rows if a < b and (n := sum(p != q for p, q in zip(x, y))) <= 5}
    assert {tuple(r) for r in got.collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    loops = [(900, 900), (None, 3)]
    got = connected_components(spark.createDataFrame(edges + loops, "src long, dst long")).collect()
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("overlap", [0, 2])
def test_chunks(spark, overlap):
    lines = ["a" * n for n in (10, 30, 5, 60, 20, 20, 1, 1, 39)]
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "i int, t string")
    got = sorted((r.first_line, r.last_line) for r in corpus.chunk_table(rows, "i", "t", 50, overlap).collect())
    want, start = [], 0
    while True:
        end, total = start, len(lines[start])
        while end + 1 < len(lines) and total + len(lines[end + 1]) <= 50:
            end += 1
            total += len(lines[end])
        want.append((start, end))
        if end == len(lines) - 1:
            break
        start = max(start + 1, end + 1 - overlap)
    assert got == want


def test_quality_route(spark):
    def route(**x):
        base = {"expected": True, "chars": 100, "boxes": 3, "confidence": 0.9, "private": False, "sensitive": False} | x
        return one(spark, corpus.quality_route(**{k: F.lit(v) for k, v in base.items()}).alias("r")).r

    assert route(expected=False, chars=12, confidence=0.88) == "category_text_leak"
    assert route(chars=0) == "ocr_retry" and route(confidence=0.5) == "ocr_low_confidence" and route() == "pass"
    assert route(private=True, sensitive=True) == "privacy_review"
    assert one(spark, corpus.contains_sensitive(F.lit("mail a.b@c.org")).alias("s")).s


def test_statistics(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert round(rows.agg(*statistics.linear_quantiles("x", 0.95)).first()[0], 9) == 3.8
    near = statistics.nearest_rank_quantiles(rows.withColumn("g", F.lit(1)), ["g"], "x", 0.5, 0.95).first()
    assert (near.nearest_p50, near.nearest_p95) == (2.0, 4.0)
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert metrics.cohen_kappa(same, "x", "y").first().kappa == 1.0
    shares = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert {r.k: r.target for r in statistics.apportioned(shares, weight="n", key="k", total=10).collect()} == {"a": 4, "b": 3, "c": 3}


def test_bootstrap_is_repeatable(spark):
    rows = spark.createDataFrame([(g, float(g % 3 == 0), float(g % 2 == 0)) for g in range(30) for _ in range(2)], "g int, a double, b double")
    run = lambda seed: statistics.paired_bootstrap(rows, group="g", baseline="a", contender="b", repetitions=200, seed=seed).first()
    x, y, z = run(1), run(1), run(2)
    assert x == y and x != z and x.low <= x.difference <= x.high and x.n_groups == 30


def test_threshold_sweep(spark):
    data = [(0.2, 0), (0.2, 1), (0.5, 0), (0.7, 1), (0.9, 1)]
    got = {r.threshold: (round(r.balanced_accuracy, 9), round(r.accuracy, 9)) for r in statistics.threshold_sweep(spark.createDataFrame(data, "s double, y int"), score="s", label="y").collect()}
    for t in (0.0, 0.2, 0.5, 0.7, 0.9, 1.0):
        tp, tn = sum(s >= t and y for s, y in data), sum(s < t and not y for s, y in data)
        assert got[t] == (round((tp / 3 + tn / 2) / 2, 9), round((tp + tn) / 5, 9))


def test_listwise(spark):
    rows = spark.createDataFrame([("q", "a", 1, 0.64), ("q", "b", 2, 0.9), ("q", "c", 3, 0.9), ("p", "a", 1, 0.1)], "query string, item string, rank int, full double")
    pick = lambda m: {r["query"]: r["item"] for r in gates.listwise(rows, m).collect()}
    assert pick("L0") == {"q": "a"} and pick("L1") == {"q": "b"} and pick("L2") == {"q": "a", "p": "a"}


def test_gated_metrics_empty_denominators(spark):
    rows = spark.createDataFrame([(True, True, 1), (True, False, 1), (True, True, None)], "answerable boolean, accepted boolean, best_rank int")
    r = metrics.gated_metrics(rows).first()
    assert (r.recall_1, r.product_recall_1, r.rejection, r.false_accept_rate) == (2 / 3, 1 / 3, 0, 0)


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "c"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v, r.added) for r in lifecycle.merge_unique(old, new, "k", F.col("v")).collect()) == [(1, "a", False), (2, "b", True)]
    assert lifecycle.duplicated_keys(new, "k").first().n == 2
    assert lifecycle.missing_references(new, "k", old, "k").count() == 2
    files = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "f string, s int, t int")
    kept = lifecycle.bounded_cache(files, name="f", size="s", newest=F.col("t").desc(), most_files=2, most_bytes=100)
    assert {r.f for r in kept.where("kept").collect()} == {"b", "c"}
    a, b = (lifecycle.set_fingerprint(df, F.col("k"), F.col("v")).first() for df in (new, new.orderBy("v")))
    assert a == b


def test_splits(spark):
    items = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, "y"), (4, "z", None)], "i int, a string, b string")
    groups = splits.token_groups(items, "i", [F.concat(F.lit("a"), "a"), F.concat(F.lit("b"), "b")])
    assert {r["item"]: r["group"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    leak = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "test")], "g string, s string")
    assert [r.g for r in splits.leaking_groups(leak, "g", "s").collect()] == ["g"]


def test_routes(spark):
    mixed = intent.Lexicon(entities=("王",))
    rows = spark.createDataFrame([("王小明",), ("蓝牙 耳机 蓝色 红色",)], "q string").select(intent.route(F.col("q"), mixed).alias("r"), intent.colour_intent(F.col("q")).alias("c")).collect()
    assert [(r.r, r.c) for r in rows] == [("entity_exact", None), ("visual_discovery", None)]
    names = ("needs_literal_text", "needs_visual_semantics", "needs_layout_structure", "needs_exact_entity", "needs_topic_discovery", "is_compositional")
    need = lambda *on: {n: F.lit(n in on) for n in names}
    r = one(spark, intent.evidence_route(need("needs_literal_text")).alias("a"), intent.evidence_route(need(*names)).alias("b"), intent.evidence_route(need()).alias("c"))
    assert tuple(r) == ("text_evidence", "entity_exact", "mixed")


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from tessera.streaming.ingest import ingest_stream

    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(source)
    for extra in ([], [(2, "again"), (3, "c")]):
        if extra:
            spark.createDataFrame(extra, "k int, v string").write.mode("append").parquet(source)
        ingest_stream(spark, source, "k", target, log).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]
