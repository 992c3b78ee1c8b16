"""Explanations, model contracts and library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import explain
from tessera.plans.registry import register
from tessera.sources.tables import table


@register("""
WITH r AS (SELECT doc_id, lang, n_chars, doc_id % 7 = 0 AS reranked, CASE doc_id % 3 WHEN 0 THEN 'visual_discovery' WHEN 1 THEN 'visual_metadata' ELSE 'mixed' END AS route,
    (doc_id % 11) / 10.0 AS t, (doc_id % 13) / 10.0 AS b, (doc_id % 5) / 10.0 AS v, (doc_id % 17) / 10.0 AS c FROM documents)
SELECT doc_id, CASE WHEN reranked THEN 'rerank' WHEN route = 'visual_discovery' THEN CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'colour' ELSE 'visual_and_colour' END ELSE 'visual' END
  WHEN route = 'visual_metadata' THEN 'metadata_and_visual' WHEN t = greatest(t, b, v, c) THEN 'text' WHEN b = greatest(t, b, v, c) THEN 'words' WHEN v = greatest(t, b, v, c) THEN 'visual' ELSE 'colour' END AS branch FROM r
""")
def q171_dominant_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of evidence that decides for every document."""
    i = F.col("doc_id")
    row = {
        "rerank": F.when(i % 7 == 0, 1.0), "route": F.when(i % 3 == 0, "visual_discovery").when(i % 3 == 1, "visual_metadata").otherwise("mixed"), "pure_colour": i % 4 == 0,
        "colour_intent": F.when(i % 2 == 0, "blue"), "text": (i % 11) / 10.0, "bm25": (i % 13) / 10.0, "visual": (i % 5) / 10.0, "colour": (i % 17) / 10.0,
    }
    told = explain.explanation(F.lit("the report"), F.lit("no such thing"), row)
    return table(spark, sf_dir, "documents").select("doc_id", told["branch"].alias("branch"))


@register("SELECT DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS query, CASE WHEN item_id % 2 = 0 THEN 'cached' ELSE 'asked' END AS payload FROM benchmark")
def q173_backend_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a backend to every benchmark text that a cache does not hold."""
    from tessera.functions.text import normalized_query

    rows = table(spark, sf_dir, "benchmark")
    cache = rows.where("item_id % 2 = 0").select(normalized_query(F.col("text")).alias("query"), F.lit("cached").alias("payload")).distinct()
    return explain.backend_answers(rows, lambda queries: ["asked"] * len(queries), query="text", cache=cache)


@register("""
SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE lang END AS lang, quality AS quality, l.doc_id IS NOT NULL AS matched FROM documents LEFT JOIN labels l USING (doc_id)
""")
def q174_enriched_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents enriched by labels where there are any."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"), "quality")
    return explain.enriched(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id", ["lang", "quality"])


@register("""SELECT c_custkey, sha256('{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS hash, 3 AS n_features FROM customer""")
def q175_canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a customer's fields whatever their order, and a feature vector's length."""
    made = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    v = explain.feature_vector([F.array(F.col("c_acctbal").cast("double")), F.array(F.lit(1.0), F.lit(0.0))])
    return table(spark, sf_dir, "customer").select("c_custkey", explain.canonical_hash(made).alias("hash"), F.size(v).alias("n_features"))
