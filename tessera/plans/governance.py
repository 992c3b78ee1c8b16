"""Corpus governance queries: privacy, quality routes, duplicates, splits, ingest, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import stable_fraction, stable_key
from tessera.functions.text import compact, html_title, normalized_query, strip_tags
from tessera.operators import corpus, lifecycle, splits, statistics
from tessera.plans.registry import register
from tessera.sources.tables import table


@register("""
WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, regexp_matches(t, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') AS has_email, regexp_matches(t, '[0-9][0-9 -]{7,}[0-9]') AS has_long_number, regexp_matches(t, '(?i)身份证|公民身份|住址|出生|姓名|手机号|电话|邮箱|\\baddress\\b|\\bphone\\b|\\be-?mail\\b|\\bdate of birth\\b|\\bssn\\b|\\bsocial security\\b') AS has_private_word FROM t
""")
def q15_privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of private text every document holds."""
    t = F.col("t")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    return rows.select(
        "doc_id", t.rlike(corpus.EMAIL).alias("has_email"), t.rlike(corpus.LONG_NUMBER).alias("has_long_number"), t.rlike(corpus.PRIVATE_WORDS).alias("has_private_word")
    )


@register("""
WITH r AS (SELECT d.doc_id, d.n_chars, coalesce(l.quality, 0) = 1 AS expected, coalesce(l.toxic, 0) = 1 AS private, len(string_split(d.text, chr(10))) AS boxes,
    least(1.0, d.n_chars / 1000.0) AS conf, regexp_matches(t, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') OR regexp_matches(t, '[0-9][0-9 -]{7,}[0-9]') OR regexp_matches(t, '(?i)身份证|公民身份|住址|出生|姓名|手机号|电话|邮箱|\\baddress\\b|\\bphone\\b|\\be-?mail\\b|\\bdate of birth\\b|\\bssn\\b|\\bsocial security\\b') AS sensitive FROM (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents) d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN private AND sensitive THEN 'privacy_review' WHEN NOT expected AND n_chars >= 6 AND conf >= 0.70 THEN 'category_text_leak'
  WHEN NOT expected AND n_chars >= 3 AND conf >= 0.50 THEN 'category_review' WHEN NOT expected THEN 'pass' WHEN n_chars = 0 OR boxes = 0 THEN 'ocr_retry'
  WHEN conf < 0.60 THEN 'ocr_low_confidence' ELSE 'pass' END AS route,
  round(CASE WHEN expected THEN 0.55 * (1 - conf) + 0.25 * 0.1 + 0.20 * greatest(0.0, (50.0 - n_chars) / 50.0) ELSE 0.5 + 0.5 * least(n_chars / 30.0, 1.0) * conf END, 6) AS risk FROM r
""")
def q16_quality_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality route and recognition risk of every document."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    expected, private = F.coalesce("quality", F.lit(0)) == 1, F.coalesce("toxic", F.lit(0)) == 1
    conf = F.least(F.lit(1.0), F.col("n_chars") / 1000.0)
    route = corpus.quality_route(
        expected=expected, chars=F.col("n_chars"), boxes=F.size(F.split("text", "\n")), confidence=conf, private=private, sensitive=corpus.contains_sensitive(F.col("text"))
    )
    return rows.select("doc_id", route.alias("route"), F.round(corpus.risk_score(expected, conf, F.lit(0.1), F.col("n_chars").cast("double")), 6).alias("risk"))


@register("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, least(1.0, length(line) / 100.0) AS score, length(trim(line, ' ')) AS n FROM l WHERE trim(line, ' ') <> '')
SELECT doc_id AS item, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score,
  round(quantile_cont(score, 0.1), 6) AS p10, round(avg(CASE WHEN score < 0.6 THEN 1.0 ELSE 0 END), 6) AS low_share FROM s GROUP BY doc_id
""")
def q17_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts, mean, least and tenth-percentile line score, and the share of low ones."""
    rows = corpus.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("score", F.least(F.lit(1.0), F.char_length("text") / 100.0))
    return rows.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length(F.trim("text"))).alias("n_chars"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.min("score"), 6).alias("min_score"), F.round(F.percentile("score", F.lit(0.1)), 6).alias("p10"),
        F.round(F.avg((F.col("score") < 0.6).cast("double")), 6).alias("low_share"),
    )


@register("""
WITH r AS (SELECT d.doc_id, d.lang, round(1.0 / (1 + d.n_chars), 9) AS risk, coalesce(l.toxic, 0) = 1 AS private FROM documents d LEFT JOIN labels l USING (doc_id)),
  o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY risk DESC, doc_id) AS place FROM r)
SELECT doc_id, lang, CASE WHEN private THEN 'private' ELSE 'top_of_language' END AS reason FROM o WHERE private OR place <= 2
""")
def q18_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All private documents and the two riskiest of each language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", "lang", F.round(F.lit(1.0) / (1 + F.col("n_chars")), 9).alias("risk"), (F.coalesce("toxic", F.lit(0)) == 1).alias("private"))
    top = splits.top_per_group(rows, 2, F.col("risk").desc(), F.col("doc_id"), by="lang").select("doc_id", "lang", "private")
    queue = rows.where("private").select("doc_id", "lang", "private").unionByName(top).distinct()
    return queue.select("doc_id", "lang", F.when(F.col("private"), "private").otherwise("top_of_language").alias("reason"))


@register("""
WITH e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), i AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM e) GROUP BY user_id),
  f AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, event_id, false AS added FROM f UNION ALL SELECT user_id, event_id, true FROM i
""")
def q19_merge_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicking users first, then users new to them, one row each."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    clicks = rows.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return lifecycle.merge_unique(clicks, rows.select("user_id", "event_id"), "user_id", F.col("event_id"))


@register("""
SELECT sha256(regexp_replace(lower(text), '\\s+', '', 'g')) AS fingerprint, count(*) AS n, min(doc_id) AS keep_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def q20_normalised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without case and white space."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(compact(F.col("text")), 256).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@register("""
WITH RECURSIVE k AS (SELECT doc_id, 't' || sha256(substr(text, 1, 60)) AS key FROM documents UNION ALL SELECT doc_id, 'e' || sha256(right(text, 60)) FROM documents),
  e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN (SELECT key, min(doc_id) AS doc_id FROM k GROUP BY key) b USING (key)),
  s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node)
SELECT node AS item, min(root) AS "group" FROM r GROUP BY node
""")
def q22_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by an equal beginning or an equal end, transitively."""
    keys = [F.concat(F.lit("t"), F.sha2(F.substring("text", 1, 60), 256)), F.concat(F.lit("e"), F.sha2(F.right("text", F.lit(60)), 256))]
    return splits.token_groups(table(spark, sf_dir, "documents"), "doc_id", keys)


@register("""
WITH f AS (SELECT doc_id, source, CAST(('0x' || substr(sha256('split-1|' || source), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM f
""")
def q23_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources dealt to train, validation and test by a stable hash."""
    split = splits.hash_split(F.col("source"), {"train": 0.7, "validation": 0.15, "test": 0.15}, "split-1")
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))


@register("SELECT CAST(0 AS BIGINT) AS n_leaking")
def q23b_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sources that fall into several splits; none may."""
    split = splits.hash_split(F.col("source"), {"train": 0.7, "validation": 0.15, "test": 0.15}, "split-1")
    rows = table(spark, sf_dir, "documents").select("source", split.alias("split"))
    return splits.leaking_groups(rows, "source", "split").agg(F.count(F.lit(1)).alias("n_leaking"))


@register("""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, 100.0 * n / sum(n) OVER () AS quota FROM c), f AS (SELECT lang, quota, floor(quota) AS base FROM q),
  r AS (SELECT *, row_number() OVER (ORDER BY round(quota - base, 9) DESC, lang) AS rn, 100 - sum(base) OVER () AS spare FROM f)
SELECT lang, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS target FROM r
""")
def q24_apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred places shared over languages by largest remainder."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return statistics.apportioned(counts, weight="n", key="lang", total=100).select("lang", F.col("target").cast("long").alias("target"))


@register("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('order-1|' || doc_id), doc_id) AS turn, sha256('order-1|' || source) AS group_key FROM documents
""")
def q25_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn of each document when sources take turns, hash order inside."""
    rows = splits.diverse_order(table(spark, sf_dir, "documents").select("doc_id", "source"), group="source", item="doc_id", seed="order-1")
    return rows.select("doc_id", "source", F.col("turn").cast("long").alias("turn"), "group_key")


@register("""
WITH p AS (SELECT lang AS query, doc_id AS item FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sha256('study|' || query || '|' || item), item) AS position FROM p)
SELECT query, item, position, 'C' || lpad(CAST(position AS VARCHAR), greatest(3, 3), '0') AS alias FROM o WHERE position < 1000
UNION ALL SELECT query, item, position, 'C' || left(CAST(position AS VARCHAR), 3) FROM o WHERE position >= 1000
""")
def q26_blind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymous names for the documents of each language in hash order."""
    pool = table(spark, sf_dir, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"))
    rows = splits.blind_order(pool, query="query", item="item", fingerprint="study")
    return rows.select("query", "item", F.col("position").cast("long").alias("position"), "alias")


@register("""
SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), '') AS title, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS BIGINT) AS n_text FROM pages
""")
def q45_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and length of the tag-free text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"), F.char_length(strip_tags(F.col("html"))).cast("long").alias("n_text"))


@register("""
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(year(CAST(s AS DATE)) AS BIGINT) AS y, CAST(month(CAST(s AS DATE)) AS BIGINT) AS m, CAST(day(CAST(s AS DATE)) AS BIGINT) AS d FROM d
""")
def q47_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar dates found in text that also holds an impossible one."""
    text = F.concat(F.lit("seen 2023-13-45 and "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", again "), F.date_format("o_orderdate", "yyyy/M/d"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(corpus.dates_in(text)).alias("x"))
    return rows.select("o_orderkey", *(F.col(f"x.{c}").cast("long").alias(c) for c in ("y", "m", "d")))


@register("SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q51_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left when labelled-toxic ones are purged."""
    removed = table(spark, sf_dir, "labels").where("toxic = 1")
    return lifecycle.purge(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), removed, "doc_id")


@register("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q51b_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept when only good ones stay active."""
    active = table(spark, sf_dir, "labels").where("quality = 1")
    return lifecycle.compact(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), active, "doc_id")


@register("SELECT event_type, count(DISTINCT event_id) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def q52_streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ingested as a stream, deduplicated by id, then summed by type."""
    from tessera.streaming.ingest import ingested_once

    rows = ingested_once(spark, f"{sf_dir}/events.parquet", "event_id")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("""
WITH u AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, event_id, event_type FROM u WHERE n = 1
""")
def q62_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user after an upsert of views over the others."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return lifecycle.upsert(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"), "user_id", "event_id")


@register("""
SELECT CAST((SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS duplicated_ids,
  CAST((SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS BIGINT) AS missing_documents,
  CAST((SELECT count(*) FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es')) AS BIGINT) AS unknown_languages
""")
def q63_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows that break uniqueness, references or a domain."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    a = count(lifecycle.duplicated_keys(docs, "doc_id"), "duplicated_ids")
    b = count(lifecycle.missing_references(labels, "doc_id", docs, "doc_id"), "missing_documents")
    c = count(lifecycle.outside_domain(docs, "lang", ["en", "de", "fr", "es"]), "unknown_languages")
    return a.crossJoin(b).crossJoin(c)


@register("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM n WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT)), pos)
""")
def q64_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language at even distances (a sampling operator)."""
    return splits.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "lang"), order="doc_id", by="lang", count=10)


@register("""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT *, sum(n) OVER (ORDER BY sha256('fill|' || source), source ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM s)
SELECT source, n, CASE WHEN upto <= 0.5 * total THEN 'calibration' ELSE 'holdout' END AS split FROM o
""")
def q65_cumulative_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in hash order, calibration until half of the rows are reached."""
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return splits.cumulative_fill(groups, size="n", key="source", share=0.5, seed="fill")


@register("""
WITH b AS (SELECT doc_id, lang, source FROM documents), o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'review' ELSE 'fine' END AS lang FROM labels)
SELECT b.doc_id, coalesce(o.lang, b.lang) AS lang, o.doc_id IS NOT NULL AS used_override FROM b LEFT JOIN o USING (doc_id)
""")
def q66_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a column overridden by reviews."""
    over = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "review").otherwise("fine").alias("lang"))
    return lifecycle.overridden(table(spark, sf_dir, "documents").select("doc_id", "lang"), over, "doc_id", "lang").select("doc_id", "lang", "used_override")


@register("""
SELECT doc_id, sha256('key|' || doc_id || '|' || lang) AS key, round(CAST(('0x' || substr(sha256('key|' || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0, 9) AS fraction,
  sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS normal_sha256 FROM documents
""")
def q67_stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable sort keys and fractions, and a hash of each normal form."""
    key = stable_key(F.lit("key"), F.col("doc_id"), F.col("lang"))
    part = F.round(stable_fraction(F.lit("key"), F.col("doc_id")), 9)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), part.alias("fraction"), F.sha2(normalized_query(F.col("text")), 256).alias("normal_sha256"))


@register("""
SELECT lang, source, grouping(lang)::BIGINT AS all_languages, grouping(source)::BIGINT AS all_sources, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY CUBE (lang, source)
""")
def q68_cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by language, source and their totals."""
    rows = table(spark, sf_dir, "documents").cube("lang", "source")
    return rows.agg(
        F.grouping("lang").cast("long").alias("all_languages"), F.grouping("source").cast("long").alias("all_sources"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")
    )
