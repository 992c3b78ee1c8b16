"""Retrieval queries: corpus statistics, BM25, vectors, fusion, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import cosine, dot, l2_normalized
from tessera.functions.text import excerpt, sparse_weight, token_count, tokens
from tessera.operators import blended, corpus, fusion, grids, lexical, products, vectors
from tessera.operators.splits import top_per_group
from tessera.plans.registry import register
from tessera.sources.tables import small, table
from tessera.sources.workspace import materialize

TOKENS = "regexp_extract_all(lower({}), '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]+|[a-zA-Z0-9]+(?:[._:/+-][a-zA-Z0-9]+)*')"

BM25_CTE = f"""
  doc_tokens AS (SELECT doc_id AS item, len(ts) AS dl, unnest(ts) AS token FROM (SELECT doc_id, {TOKENS.format("text")} AS ts FROM documents)),
  tf AS (SELECT item, dl, token, count(*) AS tf FROM doc_tokens GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  scale AS (SELECT count(*) AS n_items, avg(len({TOKENS.format("text")})) AS avg_dl FROM documents),
  asked AS (SELECT query, token, count(*) AS qf FROM (SELECT item_id AS query, unnest({TOKENS.format("text")}) AS token FROM benchmark) GROUP BY ALL),
  bm25 AS (
    SELECT query, item, sum(ln(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * 2.5
      / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(avg_dl, 1e-12))) * (1 + ln(qf))) AS score
    FROM tf JOIN df USING (token) JOIN asked USING (token) CROSS JOIN scale GROUP BY query, item)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(
        table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), query_id="item_id", query_col="text", id_col="doc_id", text_col="text"
    )


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What ``_bm25`` sums, by token."""
    return lexical.weighted_postings(
        table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), query_id="item_id", query_col="text", id_col="doc_id", text_col="text"
    )


@register(f"""
WITH {BM25_CTE},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM bm25)
SELECT query, item, rank, round(score, 6) AS score, score > 0 AS accepted FROM ranked WHERE rank <= 10
""")
def q01_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark text, with acceptance."""
    best = lexical.top_k(_bm25(spark, sf_dir), 10)
    return best.select("query", "item", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), (F.col("score") > 0).alias("accepted"))


@register(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS token FROM documents)
SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS df FROM t GROUP BY token
""")
def q02_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted-index statistics: occurrences and document frequency of every token."""
    tf = lexical.token_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tf.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


@register(f"""
SELECT count(*) AS n_items, round(avg(len({TOKENS.format("text")})), 6) AS avg_dl, max(len({TOKENS.format("text")})) AS max_dl FROM documents
""")
def q02b_corpus_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the corpus and its mean and largest length in tokens."""
    n = token_count(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg(n), 6).alias("avg_dl"), F.max(n).cast("long").alias("max_dl"))


@register("""
WITH RECURSIVE ls AS (
    SELECT doc_id AS item, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents),
  lens AS (SELECT item, ls, list_transform(ls, lambda x: length(x)) AS n FROM ls WHERE len(ls) > 0),
  lasts AS (
    SELECT item, s, CASE WHEN n[s + 1] > 400 THEN s ELSE (SELECT max(e) FROM range(s, len(n)) r(e) WHERE list_sum(n[s + 1 : e + 1]) <= 400) END AS e, len(n) AS total
    FROM lens, LATERAL (SELECT unnest(range(0, len(n))) AS s)),
  walk AS (
    SELECT item, 0 AS chunk, s, e, total FROM lasts WHERE s = 0
    UNION ALL
    SELECT w.item, w.chunk + 1, l.s, l.e, l.total FROM walk w JOIN lasts l ON l.item = w.item AND l.s = greatest(w.s + 1, w.e - 1) WHERE w.e < w.total - 1)
SELECT w.item, CAST(w.chunk AS BIGINT) AS chunk, CAST(w.s AS BIGINT) AS first_line, CAST(w.e AS BIGINT) AS last_line,
  CAST(length(array_to_string(ls[w.s + 1 : w.e + 1], chr(10))) AS BIGINT) AS n_chars
FROM walk w JOIN ls USING (item)
""")
def q03_chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into chunks of at most 400 characters with an overlap of two lines."""
    chunks = corpus.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return chunks.select(
        "item", F.col("chunk").cast("long").alias("chunk"), F.col("first_line").cast("long").alias("first_line"),
        F.col("last_line").cast("long").alias("last_line"), F.char_length("text").cast("long").alias("n_chars"),
    )


@register("""
WITH l AS (SELECT doc_id AS item, unnest(string_split(text, chr(10))) AS line FROM documents),
  q AS (SELECT item_id AS query, split_part(text, ' ', 1) AS word FROM benchmark),
  s AS (SELECT query, item, length(line) - length(replace(line, word, '')) AS score FROM l CROSS JOIN q WHERE contains(line, word))
SELECT query, d.doc_id AS item, coalesce(max(score), 0) AS score FROM documents d LEFT JOIN s ON s.item = d.doc_id WHERE query IS NOT NULL GROUP BY ALL
""")
def q04_chunk_to_doc_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line scores of each query's first word, at their maximum per document."""
    each = corpus.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.split_part("text", F.lit(" "), F.lit(1)).alias("word"))
    held = corpus.with_phrases(each.select("item", "text"), "text", words.select("word")).withColumn("word", F.explode("phrases"))
    hits = held.join(words, "word")
    score = F.char_length("text") - F.char_length(F.replace("text", F.col("word"), F.lit("")))
    return hits.groupBy("query", "item").agg(F.max(score).cast("long").alias("score"))


@register("""
WITH s AS (
  SELECT q.vec_id AS query, v.vec_id AS item, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q CROSS JOIN embeddings v),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s)
SELECT query, item, rank, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def q05_dense_knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact inner-product search of the stated query set against every vector."""
    best = products.best_products(*_sides(spark, sf_dir), 10, others=False)
    return best.select("query", "item", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries (query, v) and all items (item, v)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))


@register("""
SELECT doc_id, concat_ws('; ', 'language: ' || nullif(trim(regexp_replace(translate(lang, '_-', '  '), '\\s+', ' ', 'g')), ''),
  'source: ' || nullif(trim(regexp_replace(translate(source, '_-', '  '), '\\s+', ' ', 'g')), ''), 'length: ' || n_chars) AS metadata
FROM documents
""")
def q06_metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled metadata text of every document."""
    fields = {"language": F.col("lang"), "source": F.col("source"), "length": F.col("n_chars")}
    return table(spark, sf_dir, "documents").select("doc_id", corpus.metadata_text(fields).alias("metadata"))


KNN_CTE = """
  knn AS (
    SELECT q.vec_id AS query, v.vec_id AS item, v.label, q.label AS asked, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
    FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q CROSS JOIN embeddings v)
"""


@register(f"""
WITH {KNN_CTE}
SELECT query, item, round((score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-8), 6) AS scaled
FROM knn WINDOW w AS (PARTITION BY query)
""")
def q07_minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each query scaled to 0..1 over all items."""
    return products.scaled_products(*_sides(spark, sf_dir)).select("query", "item", F.round("scaled", 6).alias("scaled"))


FUSION_CTE = f"""
  {BM25_CTE},
  grid AS (SELECT b.item_id AS query, d.doc_id AS item, d.n_chars, d.lang FROM benchmark b CROSS JOIN documents d),
  branches AS (
    SELECT g.query, g.item, coalesce(s.score, 0.0) AS lexical, 1.0 / (1 + g.n_chars) AS prior,
      CASE WHEN l.quality IS NULL THEN 0.0 ELSE CAST(l.quality AS DOUBLE) END AS confidence, length(g.lang) + CAST(g.n_chars % 97 AS DOUBLE) AS visual
    FROM grid g LEFT JOIN bm25 s USING (query, item) LEFT JOIN labels l ON l.doc_id = g.item),
  ranks AS (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(lexical, 9) DESC, item) AS rl,
      row_number() OVER (PARTITION BY query ORDER BY round(prior, 9) DESC, item) AS rp,
      row_number() OVER (PARTITION BY query ORDER BY round(visual, 9) DESC, item) AS rv FROM branches),
  parts AS (
    SELECT *, CASE WHEN rl <= 60 AND lexical > 0 THEN 1.0 / (60 + rl) ELSE 0 END AS cl, CASE WHEN rp <= 60 THEN 1.0 / (60 + rp) ELSE 0 END AS cp,
      CASE WHEN rv <= 60 THEN 1.0 / (60 + rv) ELSE 0 END AS cv FROM ranks)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the branch scores that do not depend on a query."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "n_chars", "lang")
    return items.select("item", (F.lit(1.0) / (1 + F.col("n_chars"))).alias("prior"), (F.char_length("lang") + (F.col("n_chars") % 97).cast("double")).alias("visual"))


@register(f"""
WITH {FUSION_CTE},
  f AS (SELECT query, item, cl + cp + cv AS score FROM parts),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM f)
SELECT query, item, rank, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def q08_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of lexical score, length prior and a third branch; lexical only where positive."""
    asked, items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")), _items(spark, sf_dir)
    lexical_ranks = lexical.top_k(_bm25(spark, sf_dir).where("score > 0"), 60)
    fused = fusion.fused_ranks([lexical_ranks, fusion.shared_ranking(items, asked, "prior", 60), fusion.shared_ranking(items, asked, "visual", 60)])
    best = lexical.top_k(fused, 10)
    return best.select("query", "item", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register(f"""
WITH {FUSION_CTE},
  n AS (SELECT query, item, confidence, cl, cp, cv,
      (lexical - min(lexical) OVER w) / greatest(max(lexical) OVER w - min(lexical) OVER w, 1e-8) AS t,
      (visual - min(visual) OVER w) / greatest(max(visual) OVER w - min(visual) OVER w, 1e-8) AS v FROM parts WINDOW w AS (PARTITION BY query))
SELECT query, item, round(least(greatest(0.6 * confidence, 0), 1) * t + (1 - least(greatest(0.6 * confidence, 0), 1)) * v, 6) AS adaptive,
  round(0.5 * confidence * cp + 0.5 * confidence * cl + (1 - 0.5 * confidence) * cv, 6) AS quality_rrf FROM n
""")
def q09_quality_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence-adaptive and quality-weighted fusion of every (query, document)."""
    asked, items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")), _items(spark, sf_dir)
    share = lambda ranks, out: ranks.select("item", (F.lit(1.0) / (60 + F.col("rank"))).alias(out))
    # What does not depend on a query is worked out once an item.
    ends = items.agg(F.min("visual").alias("low"), F.max("visual").alias("high"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("confidence"))
    fixed = items.crossJoin(F.broadcast(ends)).withColumn("v", (F.col("visual") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-8))).join(labels, "item", "left")
    for score, out in (("prior", "cp"), ("visual", "cv")):
        fixed = fixed.join(F.broadcast(share(fusion.first_items(items, score, 60), out)), "item", "left")  # sixty rows
    return grids.quality_grid(*_words(spark, sf_dir), asked, fixed.na.fill(0.0, ["cp", "cv", "confidence"]))


@register(f"""
WITH {FUSION_CTE},
  n AS (SELECT p.query, item, (lexical - min(lexical) OVER w) / greatest(max(lexical) OVER w - min(lexical) OVER w, 1e-8) AS b,
      (prior - min(prior) OVER w) / greatest(max(prior) OVER w - min(prior) OVER w, 1e-8) AS t,
      (visual - min(visual) OVER w) / greatest(max(visual) OVER w - min(visual) OVER w, 1e-8) AS v FROM parts p WINDOW w AS (PARTITION BY p.query)),
  routed AS (SELECT n.*, CASE k.query % 5 WHEN 0 THEN 'text_evidence' WHEN 1 THEN 'visual_metadata' WHEN 2 THEN 'visual_discovery' WHEN 3 THEN 'topic_discovery' ELSE 'mixed' END AS route,
      CASE WHEN k.n <= 2 THEN 0.05 WHEN k.n <= 6 THEN 0.15 ELSE 0.30 END AS w
    FROM n JOIN (SELECT item_id AS query, length(array_to_string({TOKENS.format("text")}, '')) AS n FROM benchmark) k USING (query)),
  s AS (SELECT query, item, route, CASE route WHEN 'text_evidence' THEN t + 0.25 * b WHEN 'visual_metadata' THEN 0.25 * v + 0.75 * t
      WHEN 'visual_discovery' THEN 0.78 * v + 0.15 * t + 0.07 * b WHEN 'topic_discovery' THEN t + w * b ELSE v + w * b END AS score FROM routed),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s)
SELECT query, item, route, rank, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def q10_query_aware_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route-specific fusion weights, the lexical one by query length."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), sparse_weight(F.col("text")).alias("w"))
    names = F.array(*map(F.lit, ("text_evidence", "visual_metadata", "visual_discovery", "topic_discovery", "mixed")))
    asked = asked.withColumn("route", F.get(names, (F.col("query") % 5).cast("int")))
    # Two branches are the same for every query: they are scaled once, over items.
    items = _items(spark, sf_dir)
    ends = items.agg(F.count(F.lit(1)).alias("n_items"), *(f(c).alias(f"{c}_{n}") for c in ("prior", "visual") for n, f in (("low", F.min), ("high", F.max))))
    scale = lambda c: (F.col(c) - F.col(f"{c}_low")) / F.greatest(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(1e-8))
    fixed = items.crossJoin(F.broadcast(ends)).select("item", scale("prior").alias("t"), scale("visual").alias("v"))
    # The route's weights of each branch, by setting one branch to 1 and the others to 0.
    one = lambda **on: fusion.query_aware(
        F.col("route"), text=F.lit(on.get("t", 0.0)), visual=F.lit(on.get("v", 0.0)), lexical=F.lit(on.get("b", 0.0)), metadata=F.lit(on.get("t", 0.0)), fallback=F.lit(on.get("v", 0.0)), sparse=F.col("w")
    )
    weights = asked.select("query", one(t=1.0).alias("ct"), one(v=1.0).alias("cv"), one(b=1.0).alias("cb"))
    best = lexical.top_k(blended.blended_best(*_words(spark, sf_dir), weights, fixed, 10), 10).join(asked.select("query", "route"), "query")
    return best.select("query", "item", "route", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register(f"""
WITH {FUSION_CTE},
  p AS (SELECT query, item, 1 - (rl - 1) / greatest(count(*) OVER (PARTITION BY query) - 1, 1) AS pl,
    1 - (rp - 1) / greatest(count(*) OVER (PARTITION BY query) - 1, 1) AS pp, 1 - (rv - 1) / greatest(count(*) OVER (PARTITION BY query) - 1, 1) AS pv FROM parts)
SELECT query, item, round(pl, 6) AS full_percentile, round(least(pp, pv), 6) AS min_percentile, round((pp + pv) / 2, 6) AS mean_percentile,
  round(0.25 * pl + 0.75 * least(pp, pv), 6) AS blend_min, round(0.25 * pl + 0.75 * (pp + pv) / 2, 6) AS blend_mean FROM p
""")
def q11_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank percentiles of the full query and two conditions, and their blends."""
    items = _items(spark, sf_dir)
    for score, out in (("prior", "pp"), ("visual", "pv")):  # once, not for every query
        items = fusion.percentiles(items, score, out=out)
    return grids.percentile_grid(*_words(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query")), items.select("item", "pp", "pv"))


@register("""
WITH q AS (SELECT label AS query, vec_id AS slot, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
  b AS (SELECT query, slot, p.label AS passage, max(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) AS best
    FROM q CROSS JOIN embeddings p GROUP BY ALL)
SELECT query, passage, round(sum(best), 6) AS score FROM b GROUP BY query, passage
""")
def q12_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction between multi-vector queries and the vectors of each label."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("label").alias("query"), F.col("vec_id").alias("slot"), F.col("embedding").alias("v"))
    scored = vectors.maxsim(asked, rows.select(F.col("label").alias("passage"), F.col("embedding").alias("v")))
    return scored.select("query", "passage", F.round("score", 6).alias("score"))


@register("""
WITH p AS (SELECT item_id AS query, unnest([split_part(text, ' ', 1), split_part(text, ' ', 2), split_part(text, ' ', 3)]) AS phrase FROM benchmark),
  hit AS (SELECT DISTINCT query, phrase, doc_id AS item FROM p JOIN documents ON contains(text, phrase)),
  need AS (SELECT query, count(DISTINCT phrase) AS n FROM p GROUP BY query)
SELECT query, item FROM hit JOIN need USING (query) GROUP BY query, item, n HAVING count(DISTINCT phrase) = n
""")
def q13_explicit_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the first three words of a benchmark text, all of them."""
    words = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.split_part("text", F.lit(" "), i))
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(words).alias("phrase"))
    return corpus.phrase_pages(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"), phrases)


@register("""
SELECT DISTINCT doc_id AS item FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(
  regexp_replace(lower(d.text), '[^a-z0-9]', '', 'g'), regexp_replace(lower(b.text), '[^a-z0-9]', '', 'g')))
""")
def q14_exact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose compact text contains some benchmark text, compact."""
    from tessera.functions.text import compact_ascii

    terms = table(spark, sf_dir, "benchmark").select(compact_ascii(F.col("text")).alias("term"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), compact_ascii(F.col("text")).alias("page"))
    return corpus.with_phrases(pages, "page", terms).where(F.size("phrases") > 0).select("item").distinct()


@register("""
WITH e AS (SELECT vec_id AS item, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INT) ELSE 0 END))::HUGEINT AS h FROM embeddings)
SELECT a.item AS a, b.item AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM e a JOIN e b ON a.item < b.item AND bit_count(xor(a.h, b.h)) <= 5
""")
def q21_near_duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector pairs whose 64-bit sign hashes differ in at most five bits."""
    hashes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), vectors.sign_hash(F.col("embedding")).alias("h"))
    return vectors.near_hashes(hashes, 5)


@register(f"""
WITH {KNN_CTE}, {BM25_CTE.replace("scale AS", "scale2 AS").replace("CROSS JOIN scale GROUP", "CROSS JOIN scale2 GROUP")},
  lex AS (SELECT query, 'bm25' AS run, item, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM bm25),
  len_ AS (SELECT b.item_id AS query, 'length' AS run, d.doc_id AS item, row_number() OVER (PARTITION BY b.item_id ORDER BY abs(d.n_chars - length(b.text)), d.doc_id) AS rank
    FROM benchmark b CROSS JOIN documents d),
  u AS (SELECT * FROM lex UNION ALL SELECT * FROM len_),
  pool AS (SELECT query, item, sum(1.0 / (60 + rank)) AS pool_score, min(rank) AS best_rank, count(DISTINCT run) AS n_runs FROM u WHERE rank <= 50 GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (best_rank <= 3) DESC, round(pool_score, 9) DESC, best_rank, item) AS pool_rank FROM pool)
SELECT query, item, best_rank, n_runs, pool_rank, round(pool_score, 6) AS pool_score FROM o WHERE pool_rank <= 20
""")
def q27_guaranteed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two runs with the first three of each guaranteed, fillers by reciprocal rank."""
    lex = _bm25(spark, sf_dir).select("query", F.lit("bm25").alias("run"), "item", fusion.ranked("score").alias("rank"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.char_length("text").alias("n"))
    near = table(spark, sf_dir, "documents").join(small(asked)).select("query", F.col("doc_id").alias("item"), (-F.abs(F.col("n_chars") - F.col("n"))).alias("score"))
    length = near.select("query", F.lit("length").alias("run"), "item", fusion.ranked("score").alias("rank"))
    pool = fusion.guaranteed_pool(lex.unionByName(length), depth=50, guaranteed=3, size=20)
    return pool.select(
        "query", "item", F.col("best_rank").cast("long").alias("best_rank"), F.col("n_runs").cast("long").alias("n_runs"),
        F.col("pool_rank").cast("long").alias("pool_rank"), F.round("pool_score", 6).alias("pool_score"),
    )


@register(f"""
WITH b AS (SELECT item_id AS query, {TOKENS.format("text")}[1:3] AS terms FROM benchmark),
  m AS (SELECT query, doc_id, text, list_filter(terms, lambda t: contains(lower(text), t)) AS hit FROM b JOIN documents ON contains(lower(text), terms[1])),
  p AS (SELECT *, list_min(list_transform(hit, lambda t: instr(lower(text), t))) AS first FROM m),
  s AS (SELECT *, greatest(1, first - 45) AS start FROM p)
SELECT query, doc_id AS item, CAST(len(hit) AS BIGINT) AS n_matched,
  CASE WHEN start > 1 THEN '...' ELSE '' END || substr(text, start, 180) || CASE WHEN start + 180 <= length(text) THEN '...' ELSE '' END AS excerpt FROM s
""")
def q46_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched terms and an excerpt for documents that hold a query's first token."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.slice(tokens(F.col("text")), 1, 3).alias("terms"))
    asked = asked.withColumn("first", F.get("terms", F.lit(0)))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    held = corpus.with_phrases(texts, "low", asked.select("first")).select("doc_id", "text", "low", F.explode("phrases").alias("first"))
    rows = held.join(asked, "first").withColumn("hit", F.filter("terms", lambda t: F.contains(F.col("low"), t)))
    found = excerpt(F.col("text"), F.col("hit"), low=F.col("low"))
    return rows.select("query", F.col("doc_id").alias("item"), F.size("hit").cast("long").alias("n_matched"), found.alias("excerpt"))


@register("""
WITH p AS (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
  m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL)
SELECT label AS item, round(sqrt(sum(x * x)), 6) AS length_before, round(max(x) / sqrt(sum(x * x)), 6) AS largest FROM m GROUP BY label
""")
def q54_mean_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label: its length, and its largest component once normalised."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
    return means.groupBy(F.col("label").alias("item")).agg(F.round(norm, 6).alias("length_before"), F.round(F.max("x") / norm, 6).alias("largest"))


@register("""
SELECT vec_id AS item, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS squared,
  round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS mirrored FROM embeddings
""")
def q55_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of each vector and its cosine with itself reversed."""
    v = F.col("embedding")
    unit = l2_normalized(v)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), F.round(dot(v, v), 6).alias("squared"), F.round(cosine(unit, F.reverse(unit)), 6).alias("mirrored")
    )


@register(f"""
WITH {BM25_CTE},
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM bm25),
  d AS (SELECT query, item, score, lang FROM r JOIN documents ON doc_id = item WHERE rank <= 50),
  k AS (SELECT *, row_number() OVER (PARTITION BY query || '/' || lang ORDER BY round(score, 9) DESC, item) AS place FROM d)
SELECT query, lang, item, place FROM k WHERE place <= 2
""")
def q56_top_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best documents per query and language among the first fifty."""
    best = lexical.top_k(_bm25(spark, sf_dir), 50).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "lang"), "item")
    best = best.withColumn("cell", F.concat_ws("/", F.col("query").cast("string"), "lang"))
    rows = top_per_group(best, 2, F.round("score", 9).desc(), F.col("item"), by="cell")
    return rows.select("query", "lang", "item", F.col("place").cast("long").alias("place"))
