"""Review, literal-evidence and ranking-promotion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip_tags
from tessera.operators import conditions, corpus, literals, ordering, review, statistics
from tessera.plans.evaluation import RANKED_CTE, SCORED_CTE, _first_hits, _hits, _scored, _sides
from tessera.plans.registry import register
from tessera.sources.tables import table
from tessera.sources.workspace import materialize


@register("""
WITH v AS (SELECT user_id, event_type, value FROM events), e AS (SELECT user_id, event_type, count(*) AS n, count_if(value >= 20) AS sure FROM v GROUP BY ALL),
  l AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS n_votes, row_number() OVER (PARTITION BY user_id ORDER BY sure DESC, n DESC, event_type) AS p FROM e)
SELECT user_id, event_type, n, CAST(n_votes AS BIGINT) AS n_votes, sure >= floor(n_votes / 2) + 1 AS agreed FROM l WHERE p = 1
""")
def q69_vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading vote per case and whether a majority of confident votes backs it."""
    return review.consensus(table(spark, sf_dir, "events"), case="user_id", vote="event_type", confidence="value", least=20)


@register("""
WITH a AS (SELECT doc_id, quality AS d FROM labels), b AS (SELECT doc_id, 1 - toxic AS d FROM labels), c AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS d FROM documents WHERE lang <> 'de')
SELECT doc_id, CAST(CASE WHEN a.d IS DISTINCT FROM b.d THEN c.d ELSE a.d END AS INTEGER) AS decision, a.d IS DISTINCT FROM b.d AS conflict, a.d IS DISTINCT FROM b.d AND c.d IS NULL AS pending
FROM a JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def q70_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers' decisions with a third where they differ."""
    labels = table(spark, sf_dir, "labels")
    third = table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("decision"))
    a, b = labels.select("doc_id", F.col("quality").alias("decision")), labels.select("doc_id", (1 - F.col("toxic")).alias("decision"))
    return review.adjudicated(a, b, third, case="doc_id", decision="decision")


@register("""
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents), d AS (SELECT keep, doc_id AS gone FROM g WHERE doc_id <> keep)
SELECT doc_id, r.keep AS duplicate_of, CASE WHEN r.keep IS NOT NULL THEN 'removed' WHEN doc_id IN (SELECT keep FROM d) THEN 'kept' ELSE 'single' END AS dedup_role, r.keep IS NULL AS search_enabled
FROM documents LEFT JOIN (SELECT gone, min(keep) AS keep FROM d GROUP BY gone) r ON r.gone = doc_id
""")
def q71_duplicate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every document under exact-duplicate decisions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    lead = docs.groupBy("h").agg(F.min("doc_id").alias("keep"))
    decisions = docs.join(lead, "h").where("doc_id <> keep").select("keep", F.col("doc_id").alias("gone"))
    rows = review.duplicate_roles(docs.select("doc_id"), decisions, item="doc_id", keep="keep", remove="gone")
    return rows.select("doc_id", "duplicate_of", "dedup_role", "search_enabled")


@register(f"""
WITH {RANKED_CTE}, o AS (SELECT query, item, rank, row_number() OVER (PARTITION BY query ORDER BY (label = asked) DESC, rank) AS new_rank FROM ranked)
SELECT query, item, rank, new_rank FROM o WHERE new_rank <= 20
""")
def q72_promoted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings with evidence rows moved to the front, first twenty."""
    rows = review.promoted(_first_hits(spark, sf_dir, 20), F.col("label") == F.col("asked")).where("new_rank <= 20")
    return rows.select("query", "item", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


@register(f"""
WITH {RANKED_CTE},
  b AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY abs(item - query), item) AS rank, label, asked FROM ranked),
  h AS (SELECT query, max(CASE WHEN rank <= 3 AND label = asked THEN 1.0 ELSE 0 END) AS a FROM ranked GROUP BY query),
  i AS (SELECT query, max(CASE WHEN rank <= 3 AND label = asked THEN 1.0 ELSE 0 END) AS b FROM b GROUP BY query),
  q AS (SELECT DISTINCT query FROM ranked WHERE label = asked)
SELECT round(avg(a), 6)::DOUBLE AS recall_a, round(avg(b), 6)::DOUBLE AS recall_b, round(avg(greatest(a, b)), 6)::DOUBLE AS recall_union, count(*) AS n FROM q JOIN h USING (query) JOIN i USING (query)
""")
def q73_union_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at three of two runs and of their union."""
    from tessera.operators.fusion import ranked as place

    asked, items = _sides(spark, sf_dir)
    hits = materialize(_hits(spark, sf_dir, 3), "best")  # a query with relevant rows has one here
    near = ordering.neighbours(asked.select("query"), items.select("item"), 3).withColumn("near", -F.abs(F.col("item") - F.col("query")))
    near = near.join(items.select("item", "label"), "item").join(asked.select("query", "asked"), "query").withColumn("rank", place("near"))
    relevant = hits.where("label = asked").select("query", "item").unionByName(near.where("rank <= 3 and label = asked").select("query", "item"))
    out = review.union_recall(hits, near, relevant, 3)
    return out.select(*(F.round(c, 6).alias(c) for c in ("recall_a", "recall_b", "recall_union")), "n")


@register("""
WITH l AS (SELECT doc_id AS item, unnest(string_split(text, chr(10))) AS line FROM documents),
  s AS (SELECT item, line, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) AS letters FROM l WHERE trim(line, ' ') <> '')
SELECT item, count(*) AS n_lines, CAST(count_if(length(line) BETWEEN 4 AND 36 AND NOT regexp_matches(line, '[0-9]{6,}|@')
  AND NOT regexp_matches(line, '(?i)地址|住址|电话|手机|邮箱|邮件|身份证|证件号码|出生日期|姓名|学号|账号|银行卡|邮编|微信|\\baddress\\b|\\btelephone\\b|\\bphone\\b|\\be-?mail\\b|\\bpassport\\b|\\bdate of birth\\b')
  AND NOT regexp_matches(line, '(?i)https?://|www\\.|\\.com\\b|\\.cn\\b|省.{0,12}市|市.{0,12}(?:区|县|镇|路|街|号)|[0-9]+\\s+(?:avenue|street|road|boulevard)|\\bWashington,\\s*D\\.?C\\.?\\b|\\bN\\.?W\\.?\\b|\\b[0-9]{5}(?:-[0-9]{4})?\\b')
  AND letters >= 0.65 * length(line) AND length(regexp_replace(line, '[^0-9]', '', 'g')) <= 0.5 * letters AND len(regexp_extract_all(line, '[A-Za-z]+')) >= 2
  AND len(list_distinct(string_split(line, ''))) >= 3) AS BIGINT) AS n_valid FROM s GROUP BY item
""")
def q74_valid_evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that can stand as evidence."""
    rows = corpus.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(literals.valid_evidence_line(F.col("text"), F.lit(0.9))).alias("n_valid"))


@register("""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w, trim(text, ' ') AS t FROM benchmark),
  g AS (SELECT item_id, list_distinct([t] || flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i : i + n - 1], ' '))))) AS c FROM b)
SELECT item_id, CAST(len(c) AS BIGINT) AS n_candidates FROM g
""")
def q75_phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct phrase candidates of every benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(literals.phrase_candidates(F.col("text"))).cast("long").alias("n_candidates"))


@register("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
  f AS (SELECT *, CAST(year(d) AS VARCHAR) AS y, CAST(month(d) AS VARCHAR) AS m, CAST(day(d) AS VARCHAR) AS n, lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') AS yy FROM d)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, array_to_string(list_filter([y || '年' || m || '月' || n || '日', y || '-' || m || '-' || n, m || '/' || n || '/' || y, m || '/' || n || '/' || yy,
    monthname(d) || ' ' || n || ', ' || y, CASE WHEN monthname(d) <> 'May' THEN left(monthname(d), 3) || ' ' || n || ', ' || y END], lambda x: x IS NOT NULL), '|') AS forms,
  CAST(CASE WHEN year(d) % 100 >= 50 THEN year(d) % 100 + 1900 ELSE year(d) % 100 + 2000 END AS BIGINT) AS pivoted FROM f
""")
def q77_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface forms of order dates and their two-digit years back in full."""
    year = literals.four_digit_year(F.year("o_orderdate") % 100)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(literals.date_forms(F.col("o_orderdate")), "|").alias("forms"), year.cast("long").alias("pivoted"))


@register(f"""
WITH {SCORED_CTE}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS t),
  p AS (SELECT t, count_if(score >= t AND toxic = 1) / nullif(count_if(toxic = 1), 0) AS far, count_if(score >= t AND toxic = 0) / nullif(count_if(toxic = 0), 0) AS accept FROM d CROSS JOIN t GROUP BY t)
SELECT CAST(t AS DOUBLE) AS threshold, round(far, 6) AS far, round(accept, 6) AS accept FROM p WHERE far <= 0.25 + 1e-12 ORDER BY round(accept, 9) DESC, t DESC LIMIT 1
""")
def q78_constrained_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold that accepts most under a bound on false accepts."""
    grid = F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)))).alias("threshold")
    rows = _scored(spark, sf_dir).select("score", "toxic", grid).groupBy("threshold").agg(
        (F.count_if((F.col("score") >= F.col("threshold")) & (F.col("toxic") == 1)) / F.nullif(F.count_if(F.col("toxic") == 1), F.lit(0))).alias("far"),
        (F.count_if((F.col("score") >= F.col("threshold")) & (F.col("toxic") == 0)) / F.nullif(F.count_if(F.col("toxic") == 0), F.lit(0))).alias("accept"),
    )
    best = review.constrained_threshold(rows, far="far", accept="accept", most_far=0.25)
    return best.select("threshold", F.round("far", 6).alias("far"), F.round("accept", 6).alias("accept"))


@register("""
WITH t AS (SELECT conv_id, list_distinct(list_transform(regexp_extract_all(lower(string_agg(CASE WHEN role = 'user' THEN text END, ' ')), '[a-z]{4,}'), lambda x: x)) AS g,
    list_distinct(regexp_extract_all(lower(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ')), '[a-z]{4,}')) AS p FROM conversations GROUP BY conv_id),
  c AS (SELECT sum(len(list_intersect(g, p))) AS tp, sum(len(p)) - sum(len(list_intersect(g, p))) AS fp, sum(len(g)) - sum(len(list_intersect(g, p))) AS fn FROM t WHERE g IS NOT NULL AND p IS NOT NULL)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
""")
def q79_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro scores of the words of answers against those of questions."""
    words = lambda role: F.regexp_extract_all(F.lower(F.listagg(F.when(F.col("role") == role, F.col("text")), F.lit(" "))), F.lit("[a-z]{4,}"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(words("user").alias("gold"), words("assistant").alias("said"))
    rows = rows.where("gold is not null and said is not null").withColumn("all", F.lit(1))
    out = review.set_scores(rows, "gold", "said", ["all"])
    return out.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@register()
def q80_fuzzy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages hold each benchmark text in their lines, exactly or nearly, and how near; these texts are the stated query set."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.split(strip_tags(F.col("html")), "\n").alias("lines"))
    hits = conditions.fuzzy_hits(pages, terms, fuzzy=0.95).groupBy("term_id").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.max("similarity"), 6).alias("best"))
    return terms.select("term_id").join(hits, "term_id", "left").na.fill(0, ["n_pages"])


@register("""
WITH f AS (SELECT event_id, user_id, value FROM events), o AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS n, sum(event_id) OVER (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id AS event_id, max(value) AS value FROM f GROUP BY user_id))
SELECT event_id AS user_id, n <= 20 AND s <= 1000 AS kept FROM o
""")
def q81_bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries a cache of limited count and size keeps, newest first."""
    from tessera.operators.lifecycle import bounded_cache

    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("value"))
    return bounded_cache(rows, name="user_id", size="user_id", newest=F.col("value").desc(), most_files=20, most_bytes=1000).select("user_id", "kept")


@register(f"""
WITH {SCORED_CTE}, c AS (SELECT unnest(['a', 'b', 'c']) AS config, unnest([0.2, 0.5, 0.8]) AS t), m AS (SELECT lang, config, avg(CASE WHEN (score >= t) = (quality = 1) THEN 1.0 ELSE 0 END) AS acc FROM d CROSS JOIN c GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(acc, 9) DESC, config) AS n FROM m)
SELECT lang, config, round(acc, 6) AS accuracy FROM w WHERE n = 1
""")
def q82_grid_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning configuration of a literal grid in each language."""
    grid = F.explode(F.array(*(F.struct(F.lit(c).alias("config"), F.lit(t).alias("t")) for c, t in (("a", 0.2), ("b", 0.5), ("c", 0.8))))).alias("g")
    right = ((F.col("score") >= F.col("g.t")) == (F.col("quality") == 1)).cast("double")
    rows = _scored(spark, sf_dir).select("lang", "score", "quality", grid).groupBy("lang", F.col("g.config").alias("config")).agg(F.avg(right).alias("accuracy"))
    best = statistics.best_by(rows, F.round("accuracy", 9).desc(), F.col("config"), by=("lang",))
    return best.select("lang", "config", F.round("accuracy", 6).alias("accuracy"))
