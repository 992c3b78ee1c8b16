"""Lexical scores blended inside blocks against the plain sum over all pairs."""

import pytest

from tessera.operators import blended, lexical
from tessera.plans import catalogue


@pytest.mark.parametrize("everywhere", [False, True])
def test_blocks_give_the_ranking_of_all_pairs(spark, monkeypatch, everywhere):
    for name, size in (("ITEMS_BLOCK", 7), ("QUERIES_BLOCK", 2), ("TERMS", 5)):
        monkeypatch.setattr(blended, name, size)
    words = ["red", "blue", "green", "old", "new"]
    text = lambda i: " ".join([words[i % 5], words[i * i % 5], *(["all"] if everywhere else [])] * (1 + i % 2)) if i % 11 or everywhere else ""
    docs = spark.createDataFrame([(i, text(i)) for i in range(40)], "item long, text string")
    asks = spark.createDataFrame([(0, "red red blue all"), (1, "green all"), (2, "nothing"), (3, None), (4, "new old all")], "query long, text string")
    items = docs.selectExpr("item", "(item % 4) / 4D as t", "(item % 3) / 3D as v")
    queries = asks.selectExpr("query", "0.15D as ct", "0.78D as cv", "CASE query WHEN 1 THEN 0D ELSE 0.3D END as cb")
    names = {"query_id": "query", "query_col": "text", "id_col": "item", "text_col": "text"}
    got = lexical.top_k(blended.blended_best(*lexical.weighted_postings(asks, docs, **names), queries, items, 6), 6)
    score = {(r.query, r.item): r.score for r in lexical.bm25(asks, docs, **names).collect()}
    want = []
    for q in range(5):
        s = [score.get((q, i), 0.0) for i in range(40)]
        low, high = min(s), max(s)
        total = [0.78 * ((i % 3) / 3) + 0.15 * ((i % 4) / 4) + (0 if q == 1 else 0.3) * ((s[i] - low) / max(high - low, 1e-8)) for i in range(40)]
        order = sorted(range(40), key=lambda i: (-round(total[i], 9), i))[:6]
        want += [(q, n, i, round(total[i], 6)) for n, i in enumerate(order, 1)]
    assert sorted((r.query, r["rank"], r.item, round(r.score, 6)) for r in got.collect()) == want


def test_q10_does_not_join_postings_with_queries(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "bm25", None)
    assert catalogue.QUERIES["q10_query_aware_fusion"](spark, small).count() > 0
