"""Choosing sources, searching configurations, building an index, opening archives, attaching candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fusion, inverted, products, search, selection
from tessera.plans.registry import register
from tessera.sources.archives import archive_members
from tessera.sources.tables import table
from tessera.sources.workspace import application_folder

# A document's identity: its source and length, and every line of forty characters or more.
KEYS_SQL = "list_distinct(list_concat([coalesce(source, '') || '|' || n_chars], list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) >= 40)))"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.char_length(x) >= 40)
    own = F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array_distinct(F.concat(F.array(own), lines)).alias("keys"))


@register(f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('pick|' || doc_id), doc_id) AS n, doc_id, {KEYS_SQL} AS keys FROM documents
    WHERE doc_id % 97 <> 0 AND NOT list_has_any({KEYS_SQL}, (SELECT list_distinct(flatten(list({KEYS_SQL}))) FROM documents WHERE doc_id % 97 = 0))),
  r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST([] AS VARCHAR[]) AS taken
    UNION ALL SELECT o.n, CASE WHEN list_has_any(o.keys, r.taken) THEN NULL ELSE o.doc_id END, CASE WHEN list_has_any(o.keys, r.taken) THEN r.taken ELSE list_concat(r.taken, o.keys) END FROM r JOIN o ON o.n = r.n + 1)
SELECT doc_id FROM r WHERE doc_id IS NOT NULL
""")
def q176_independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share neither length and source nor a long line with each other or with an excluded set."""
    rows = _sources(spark, sf_dir)
    barred = rows.where("doc_id % 97 = 0").select(F.explode("keys").alias("key"))
    return selection.independent_items(rows.where("doc_id % 97 <> 0"), item="doc_id", keys="keys", seed="pick", excluded=barred).select(F.col("item").alias("doc_id"))


@register()
def q177_balanced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language up to a twentieth of its documents, none of which overlap."""
    rows = _sources(spark, sf_dir)
    quotas = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / 20).alias("wanted")).where("lang is not null")
    return selection.balanced_items(rows, quotas, item="doc_id", keys="keys", cell="lang", seed="cells").withColumnsRenamed({"item": "doc_id", "cell": "lang"})


@register("""
WITH p AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents WHERE source IS NOT NULL),
  f AS (SELECT source AS "group", max(lang) FILTER (n = 1) AS stratum, max(doc_id) FILTER (n = 1) AS target, max(doc_id) FILTER (n = 2) AS neighbour FROM p WHERE n <= 2 GROUP BY source),
  k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('family|' || "group"), "group") AS place FROM f WHERE neighbour IS NOT NULL)
SELECT "group", stratum, target, neighbour FROM k JOIN (SELECT lang, ceil(count(*) / 400) AS wanted FROM documents GROUP BY lang) w ON w.lang = stratum WHERE place <= wanted
""")
def q178_source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and neighbour of some sources of each language."""
    rows = table(spark, sf_dir, "documents")
    counts = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / 400).alias("wanted"))
    return selection.source_families(rows, counts, item="doc_id", group="source", stratum="lang", order="n_chars", seed="family")


@register("SELECT count(*) AS rows, count(DISTINCT vec_id) AS items, count(*) FILTER (vec_id % 50 = 0) AS queries, true AS enough FROM embeddings")
def q179_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping appends leave one row an item; recall at 10 against the exact search is 0.9 or more."""
    rows = table(spark, sf_dir, "embeddings")
    root = f"{application_folder(spark)}/index-{uuid.uuid4().hex}"
    inverted.create_index(root, rows, item="vec_id", vector="embedding", cells=16)
    for part in ("vec_id % 3 <> 0", "vec_id % 2 = 0", "true"):
        inverted.append(root, rows.where(part), item="vec_id", vector="embedding")
    asked = rows.where("vec_id % 50 = 0")
    found = inverted.search(root, asked, query="vec_id", vector="embedding", k=10, probe=13).select("query", "item")
    queries = asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    exact = products.best_products(queries, rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 10, others=False).select("query", "item")
    met = exact.join(found.withColumn("hit", F.lit(1)), ["query", "item"], "left").agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.countDistinct("query").alias("queries"))
    held = inverted.indexed(spark, root).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("item").alias("items"))
    return held.crossJoin(met)  # one row each


@register("""
WITH d AS (SELECT doc_id, doc_id // 25 AS archive, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
  a AS (SELECT archive, count(*) AS n FROM d GROUP BY archive)
SELECT archive, doc_id || '.txt' AS member, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS digest, CAST(NULL AS VARCHAR) AS refused FROM d WHERE archive % 5 = 0
UNION ALL SELECT archive, NULL, NULL, NULL, CASE archive % 5 WHEN 1 THEN 'unsafe path' WHEN 2 THEN 'link' WHEN 3 THEN 'encrypted' ELSE 'too many files' END FROM a WHERE archive % 5 > 0
""")
def q180_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of twenty-five documents each: a fifth is sound, the others climb out, link, encrypt or hold too many files."""

    def packed(key, rows):
        import io
        import zipfile

        import pandas as pd

        held, bad = io.BytesIO(), int(key[0]) % 5
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as out:
            for i, text in zip(rows["doc_id"], rows["text"], strict=True):
                out.writestr(f"{i}.txt", (text or "").encode())
            out.writestr("notes.bin", b"no text")
            if bad == 1:
                out.writestr("../../escape.txt", b"x")
            if bad == 2:
                link = zipfile.ZipInfo("link.txt")
                link.external_attr = 0o120777 << 16
                out.writestr(link, b"/etc/passwd")
            for i in range(40 * (bad == 4)):
                out.writestr(f"more{i}.txt", b"")
        data = bytearray(held.getvalue())
        if bad == 3:  # the directory's first entry says that it is encrypted
            data[data.index(b"PK\x01\x02") + 8] |= 1
        return pd.DataFrame({"archive": [int(key[0])], "content": [bytes(data)]})

    rows = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", F.expr("doc_id div 25").alias("archive"))
    archives = rows.groupBy("archive").applyInPandas(packed, "archive long, content binary")
    found = archive_members(archives, content="content", suffixes=(".txt",), max_files=40)
    return found.select("archive", "member", "size", F.sha2("content", 256).alias("digest"), "refused")


@register("""
WITH r AS (SELECT c_custkey, 'price' AS run, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS place FROM customer JOIN orders ON o_custkey = c_custkey
  UNION ALL SELECT c_custkey, 'recent', o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, run, o_orderkey, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3
""")
def q181_attached_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the three dearest and the three latest orders."""
    orders = table(spark, sf_dir, "orders")
    run = lambda c: orders.select(F.col("o_custkey").alias("c_custkey"), F.struct(F.col(c).cast("string" if c == "o_orderdate" else "double").alias("by"), F.col("o_orderkey").alias("key")).alias("best"))
    asked = table(spark, sf_dir, "customer").select("c_custkey")
    parts = [fusion.attached_candidates(asked, {n: run(c)}, key="c_custkey", order="best").select("c_custkey", "run", F.col("best.key").alias("o_orderkey"), "place") for n, c in (("price", "o_totalprice"), ("recent", "o_orderdate"))]
    return parts[0].unionByName(parts[1])


BRANCHES = ("overlap", "cover", "brief", "english")
RANKERS = search.rankers(BRANCHES, weights=(0.2, 0.35, 0.5, 0.65, 0.8), caps=(0.4, 0.6, 0.8, 1.0), scales=(0.0, 0.5, 1.0, 1.5, 2.0), text="overlap", visual="brief", lexical="cover", confidence="english")


def _words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.char_length(w) >= 6))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts and the documents that share a long word, with four branch scores."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"), _words("text").alias("qw"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("text", F.lit("")).alias("text")).withColumn("w", _words("text"))
    shared = docs.select("doc_id", F.explode("w").alias("word")).join(asked.select("query", F.explode("qw").alias("word")), "word").groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    sized = docs.select("doc_id", "lang", "n_chars", "text", F.size("w").alias("dn"))
    rows = shared.join(asked.select("query", "q", F.size("qw").alias("qn")), "query").join(sized, "doc_id")
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("query") % 3 + 1).cast("int"))
    return rows.select(
        "query", "doc_id", split.alias("split"), F.contains("text", "q").alias("relevant"), (F.col("n") / F.col("qn")).alias("overlap"), (F.col("n") / F.col("dn")).alias("cover"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("n_chars") / F.lit(1000.0))).alias("brief"), F.when(F.col("lang") == "en", 1.0).otherwise(0.5).alias("english"),
    )


SHARED_PAIRS = """
WITH q AS (SELECT item_id AS query, text AS q, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 6)) AS qw FROM benchmark),
  d AS (SELECT doc_id, lang, coalesce(n_chars, 0) AS n_chars, coalesce(text, '') AS text, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 6)) AS w FROM documents),
  s AS (SELECT query, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN (SELECT query, unnest(qw) AS word FROM q) USING (word) GROUP BY ALL),
  p AS (SELECT query, doc_id, CASE query % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, contains(text, q) AS relevant, n / len(qw) AS overlap, n / len(w) AS cover,
    1.0::DOUBLE / (1.0::DOUBLE + n_chars / 1000.0::DOUBLE) AS brief, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS english FROM s JOIN q USING (query) JOIN d USING (doc_id)),
  g AS (SELECT *, [overlap, cover, brief, english,
""" + ", ".join(f"{w!r}::DOUBLE * overlap + {1.0 - w!r}::DOUBLE * brief" for w in (0.2, 0.35, 0.5, 0.65, 0.8)) + ", " + ", ".join(
    f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {cap}::DOUBLE * english)) * (overlap + {scale}::DOUBLE * cover) + (1.0::DOUBLE - least(1.0::DOUBLE, greatest(0.0::DOUBLE, {cap}::DOUBLE * english))) * brief"
    for cap in (0.4, 0.6, 0.8, 1.0) for scale in (0.0, 0.5, 1.0, 1.5, 2.0)
) + """, sqrt(overlap * brief)] AS v FROM p),
  e AS (SELECT split, query, relevant, unnest(v) AS s, unnest(range(len(v))) AS place FROM g),
  b AS (SELECT *, max(s) FILTER (relevant) OVER (PARTITION BY query, place) AS best FROM e),
  r AS (SELECT split, query, place, CASE WHEN max(best) IS NOT NULL THEN 1 + count(*) FILTER (s > best) END AS rank FROM b GROUP BY ALL),
  n AS (SELECT place, CASE WHEN place < 4 THEN ['overlap', 'cover', 'brief', 'english'][place + 1] WHEN place < 9 THEN 'fixed' WHEN place < 29 THEN 'adaptive' ELSE 'product' END AS family, split, count(*) AS queries,
    count(*) FILTER (rank = 1) / count(*) AS hit, count(*) FILTER (rank <= 10) / count(*) AS recall,
    sum(CASE WHEN rank <= 10 THEN CAST(floor(2520000000.0::DOUBLE / rank) AS BIGINT) ELSE 0 END) / (count(*) * 2520000000.0::DOUBLE) AS mrr FROM r GROUP BY ALL),
  t AS (SELECT a.place, a.family, b.hit, b.recall, b.mrr, row_number() OVER (PARTITION BY a.family ORDER BY a.mrr DESC, a.hit DESC, a.recall DESC, a.place) AS k FROM n a JOIN n b USING (place) WHERE a.split = 'train' AND b.split = 'validation'),
  c AS (SELECT place FROM t WHERE k = 1 ORDER BY mrr DESC, hit DESC, recall DESC, place LIMIT 1)
"""


@register(SHARED_PAIRS + "SELECT CAST(place AS INTEGER) AS place, family, split, queries, hit, recall, mrr FROM n WHERE split <> 'test'")
def q182_configuration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty rankers of seven families on the train and validation queries."""
    return search.configuration_metrics(_pairs(spark, sf_dir).where("split <> 'test'"), RANKERS, BRANCHES).drop("name")


@register(SHARED_PAIRS + "SELECT family, queries, hit, recall, mrr FROM n JOIN c USING (place) WHERE split = 'test'")
def q183_frozen_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics of the family winner on train that is best on validation."""
    pairs = _pairs(spark, sf_dir)
    chosen = search.frozen(search.select_configuration(search.configuration_metrics(pairs.where("split <> 'test'"), RANKERS, BRANCHES)))
    return search.test_metrics(pairs, RANKERS, chosen, BRANCHES).drop("split", "name")
