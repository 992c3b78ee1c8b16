"""The best items by BM25 without a row for every pair that shares a token."""

import pytest

from tessera.operators import lexical
from tessera.plans import intent


@pytest.mark.parametrize("common", [0, 3, 20, 10_000])
def test_best_equals_the_ranking_of_all(spark, common):
    pages = intent.reference_pages(spark.range(200))
    asked = intent.reference_queries(pages, pages.id % 10 == 0, pages.id % 10 == 5)
    names = {"query_id": "query", "query_col": "text", "id_col": "item", "text_col": "text"}
    plain = lambda rows: sorted((r.query, r["rank"], r.item, round(r.score, 6)) for r in rows.collect())
    assert plain(lexical.bm25_best(asked, pages, 7, common=common, **names)) == plain(lexical.top_k(lexical.bm25(asked, pages, **names), 7))


def test_reproduction_scores_no_pair_by_common_tokens(spark, monkeypatch):
    monkeypatch.setattr(lexical, "bm25", None)
    pages = intent.reference_pages(spark.range(80))
    row = intent.reproduced(pages, intent.reference_queries(pages, pages.id % 10 == 0, pages.id % 10 == 5, unused="000")).first()
    assert (row.recall_1, row.rejection, row.n_queries) == (1.0, 1.0, 16)


def test_every_supplier_is_asked_for(spark, small):
    n = spark.read.parquet(f"{small}/supplier.parquet").count()
    row = intent.q53_reference_reproduction(spark, small).first()
    assert (row.n_queries, row.missing_reference, row.end_to_end) == (2 * n, n, 1.0)
