"""Study, review, split and storage queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import compact_ascii, edge_trimmed, normalized_ocr
from tessera.operators import lifecycle, review, studies, vectors
from tessera.plans.evaluation import RANKED_CTE, _hits, _ranked
from tessera.plans.registry import register
from tessera.sources import readers
from tessera.sources.tables import table
from tessera.sources.workspace import application_folder


@register("""
SELECT d.doc_id, CASE WHEN r = '' THEN 'high_uncertainty' ELSE r END AS reasons FROM (
  SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'privacy' END, CASE WHEN lang = 'de' THEN 'category' END, CASE WHEN NOT e AND n_chars >= 5 THEN 'no_text_false_positive' END,
    CASE WHEN e AND least(1.0, n_chars / 1000.0) < 0.75 THEN 'low_confidence' END, CASE WHEN e AND n_chars < 20 THEN 'sparse_ocr' END) AS r
  FROM (SELECT doc_id, toxic, lang, n_chars, quality = 1 AS e FROM documents JOIN labels USING (doc_id))) d
""")
def q112_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why every labelled document is to be reviewed."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return rows.select("doc_id", studies.review_reasons(F.col("toxic") == 1, F.col("lang") == "de", F.col("quality") == 1, n, F.least(F.lit(1.0), n / 1000.0)).alias("reasons"))


@register(f"""
WITH {RANKED_CTE}, r AS (SELECT query, min(CASE WHEN label = asked THEN rank END) AS rank, max(CASE WHEN rank = 1 THEN score END) AS best FROM ranked GROUP BY query),
  z AS (SELECT query, query % 3 = 0 AS no_answer, best >= 0.3 AS accepted, CASE WHEN query % 7 = 0 THEN NULL ELSE rank END AS rank, query % 2 = 0 AS indexed, best FROM r)
SELECT query, CASE WHEN no_answer THEN CASE WHEN accepted THEN 'false_accept' ELSE '' END ELSE concat_ws(',', CASE WHEN NOT accepted THEN 'false_reject' END,
    CASE WHEN rank IS NULL THEN 'recall_miss_top_100' WHEN rank > 10 THEN 'recall_miss_top_10' WHEN rank > 1 THEN 'ranking_error_top_1' END) END AS errors,
  CASE WHEN NOT indexed THEN 'visual_semantics_missing' WHEN best < 0.7 THEN 'ocr_noise' ELSE 'semantic_ranking_ambiguity' END AS cause FROM z
""")
def q113_retrieval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every query and their likeliest cause."""
    ranked = _hits(spark, sf_dir, 10).groupBy("query").agg(
        F.min(F.when(F.col("label") == F.col("asked"), F.col("rank"))).alias("rank"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best")
    )
    rank = F.when(F.col("query") % 7 != 0, F.col("rank"))
    errors = studies.retrieval_errors(F.col("query") % 3 == 0, F.col("best") >= 0.3, rank)
    return ranked.select("query", F.array_join(errors, ",").alias("errors"), studies.error_cause(F.col("query") % 2 == 0, F.col("best")).alias("cause"))


@register("""
WITH f AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY source),
  o AS (SELECT *, n % 2 AS odd, sum(n % 2) OVER (ORDER BY stratum ROWS UNBOUNDED PRECEDING) AS turn FROM f)
SELECT stratum, CAST(n // 2 + CASE WHEN odd = 1 AND turn % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS development, CAST(n - n // 2 - CASE WHEN odd = 1 AND turn % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS holdout FROM o
""")
def q116_split_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development and holdout slots of each source."""
    return studies.split_slots(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("n")))


@register("""
WITH f AS (SELECT vec_id AS family_id, 'r' || (label % 6) AS route, CASE WHEN vec_id % 2 = 0 THEN 'calibration' ELSE 'holdout' END AS split FROM embeddings),
  n AS (SELECT *, row_number() OVER (PARTITION BY route, split ORDER BY sha256('s:' || family_id)) AS n, CAST(right(route, 1) AS INT) % 2 = 0 AS even FROM f)
SELECT family_id, route, split FROM n WHERE n <= CASE WHEN even = (split = 'calibration') THEN 2 ELSE 1 END
""")
def q117_chosen_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and one families of each route and split in hash order."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("family_id"), F.concat(F.lit("r"), F.col("label") % 6).alias("route"), F.when(F.col("vec_id") % 2 == 0, "calibration").otherwise("holdout").alias("split")
    )
    return studies.chosen_families(rows, [f"r{i}" for i in range(6)], "s").select("family_id", "route", "split")


@register()
def q118_balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups of documents dealt to splits that fill evenly in total and by language."""
    rows = table(spark, sf_dir, "documents").withColumn("family", F.concat_ws("-", "source", F.col("doc_id") % 40))
    return studies.balanced_groups(rows, group="family", category="lang", shares={"train": 0.7, "validation": 0.15, "test": 0.15}, seed="s")


@register("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'source-neighbor:h' || doc_id % 7 WHEN source IS NOT NULL AND trim(source) <> '' THEN 'source:' || trim(source) ELSE 'item:' || doc_id END AS grp,
  CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 3 END - CASE WHEN source IS NULL OR trim(source) = '' THEN 1 ELSE 0 END AS n_keys,
  NOT (doc_id % 11 = 0) AND lang IN ('en', 'de') AND n_chars >= 8 AND doc_id % 3 <> 0 AS eligible FROM documents
""")
def q119_study_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, identities and eligibility of every document as a study's source."""
    rows = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    hard = F.when(i % 5 == 0, F.concat(F.lit("h"), i % 7))
    seen = {
        "private": i % 11 == 0, "dedup_role": F.lit("single"), "source_path": F.lit("x"), "category": F.col("lang"), "has_text": F.lit(True),
        "status": F.when(i % 3 == 0, "error").otherwise("success"), "characters": F.col("n_chars"), "boxes": F.lit(1),
    }
    keys = studies.source_keys(hard, F.col("source"), F.concat(F.lit("p"), i), i)
    return rows.select(
        "doc_id", studies.source_group(hard, F.col("source"), i).alias("grp"), F.size(keys).alias("n_keys"), studies.eligible_source(seen, ("en", "de"), needs_text=True).alias("eligible")
    )


@register("""
WITH p AS (SELECT doc_id AS query_id, CAST(doc_id // 2 AS BIGINT) AS group_id FROM documents), a AS (SELECT doc_id AS query_id, quality AS a, toxic AS b FROM labels),
  g AS (SELECT DISTINCT group_id FROM p JOIN a USING (query_id) WHERE a <> b)
SELECT query_id, group_id, count(*) OVER (PARTITION BY group_id) = 2 AS whole FROM p WHERE group_id IN (SELECT group_id FROM g)
""")
def q120_adjudication_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of pairs of documents on which two labels differ."""
    packets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.floor(F.col("doc_id") / 2).alias("group_id"))
    labels = table(spark, sf_dir, "labels")
    vote = lambda c: labels.select(F.col("doc_id").alias("query_id"), F.col(c).alias("decision"))
    return studies.adjudication_packets(packets, vote("quality"), vote("toxic"))


@register("""
WITH j AS (SELECT DISTINCT event_type AS query_id, user_id % 4 AS reviewer_id FROM events WHERE user_id % 4 < CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END), n AS (SELECT query_id, count(*) AS n FROM j GROUP BY query_id)
SELECT query_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type AS query_id FROM events) LEFT JOIN n USING (query_id) WHERE coalesce(n, 0) <> 3
""")
def q121_reviewer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types without exactly three reviewers."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("query_id"), (F.col("user_id") % 4).alias("reviewer_id"))
    most = F.when(F.col("query_id") == "click", 2).when(F.col("query_id") == "view", 3).otherwise(4)
    return studies.reviewed_by(events.where(F.col("reviewer_id") < most), events, 3)


@register("""
WITH t AS (SELECT event_type AS split, user_id AS query, count(DISTINCT event_id % 3) AS n_reviewers FROM events GROUP BY ALL)
SELECT split, n_reviewers, count(*) AS n_queries FROM t GROUP BY ALL
""")
def q122_coverage_by_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per event type and number of reviewers."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.col("user_id").alias("query"), (F.col("event_id") % 3).alias("reviewer"))
    return review.coverage_by_reviewers(rows, query="query", reviewer="reviewer", split="split")


@register("""
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'moved' WHEN quality = 1 THEN 'current' WHEN doc_id % 4 = 0 THEN 'proposed' ELSE 'current' END AS label,
  quality = 1 AS reviewed, doc_id % 4 = 0 AND doc_id % 8 = 0 AS active FROM labels
""")
def q123_effective_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that counts for every labelled document, and whether its proposal stands."""
    i = F.col("doc_id")
    decision = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "reclassified").otherwise("accepted"))
    proposal = F.when(i % 4 == 0, "proposed")
    status = F.when(i % 8 == 0, "").otherwise("withdrawn")
    return table(spark, sf_dir, "labels").select(
        "doc_id", review.effective_label(F.lit("current"), decision, F.lit("moved"), proposal).alias("label"), studies.is_category_review(decision).alias("reviewed"),
        studies.is_active_proposal(status, proposal, ("proposed",)).alias("active"),
    )


@register("""
WITH d AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, text AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL),
  e AS (SELECT DISTINCT k FROM d WHERE length(k) % 2 = 0)
SELECT min(query) AS query FROM d WHERE length(k) BETWEEN 2 AND 200 AND k NOT IN (SELECT k FROM e) GROUP BY k
""")
def q125_new_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User texts that were not submitted before, one of each."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select(F.col("text").alias("query"))
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    return studies.new_submissions(rows.where(F.char_length(key) % 2 == 0), rows).select("query")


@register("SELECT v AS event_type, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('never')) t(v) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) e ON v = event_type")
def q126_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three types, one of which never occurs."""
    return studies.counts_in_domain(table(spark, sf_dir, "events"), "event_type", ("click", "view", "never"))


@register("""
WITH m AS (SELECT doc_id AS item_id, lang AS category, doc_id % 2 = 0 AS search_enabled FROM documents),
  r AS (SELECT doc_id AS item_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN quality = 1 THEN 'reclassified' ELSE 'quarantined' END AS d FROM labels)
SELECT item_id, CASE WHEN d = 'reclassified' THEN 'other' ELSE category END AS category, CASE WHEN d = 'reclassified' THEN category END AS original_category,
  CASE WHEN d IS NULL THEN search_enabled ELSE d IN ('accepted', 'reclassified') END AS search_enabled, d AS quality_decision FROM m LEFT JOIN r USING (item_id)
""")
def q127_reviewed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' manifest with quality reviews applied."""
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("category"), (F.col("doc_id") % 2 == 0).alias("search_enabled"))
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("quality") == 1, "reclassified").otherwise("quarantined")
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), decision.alias("decision"), F.lit("other").alias("revised_category"))
    return studies.reviewed_manifest(manifest, reviews)


@register("""
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer WHERE c_custkey % 9 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 8 <> 0)
SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NOT NULL AS on_both FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s
""")
def q128_contract_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on which two versions of a table differ."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    other = rows.where("k % 8 <> 0").withColumn("s", F.when(F.col("k") % 10 == 0, "X").otherwise(F.col("s")))
    return studies.contract_differences(rows.where("k % 9 <> 0"), other, "k", ["s"])


@register("""
WITH g AS (SELECT source, dense_rank() OVER (ORDER BY sha256('public|' || source), source) AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT doc_id, 'G' || lpad(CAST(n AS VARCHAR), 3, '0') AS alias FROM documents JOIN g USING (source)
""")
def q129_anonymous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sources under aliases."""
    return studies.anonymous_groups(table(spark, sf_dir, "documents").where("source is not null"), "source").select("doc_id", "alias")


@register("""
SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')) AS normal, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS n_compact FROM documents WHERE lang = 'en'
""")
def q130_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts in normal form."""
    rows = table(spark, sf_dir, "documents").where("lang = 'en'")
    return rows.select("doc_id", normalized_ocr(F.col("text")).alias("normal"), F.char_length(compact_ascii(F.col("text"))).cast("long").alias("n_compact"))


@register("""
SELECT item_id, regexp_replace(regexp_replace('(' || text || ' ).', '\\s+', ' ', 'g'), '^[\\s.,;:!?''"()\\[\\]-]+|[\\s.,;:!?''"()\\[\\]-]+$', '', 'g') AS trimmed FROM benchmark
""")
def q131_edge_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts without the marks around them."""
    return table(spark, sf_dir, "benchmark").select("item_id", edge_trimmed(F.concat(F.lit("("), F.col("text"), F.lit(" )."))).alias("trimmed"))


@register("""
SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), lang)), 1, 12) AS BIGINT)) AS VARCHAR) AS hash_sum FROM documents
""")
def q132_set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of the documents that does not depend on their order."""
    return lifecycle.set_fingerprint(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("lang"))


@register("""
WITH u AS (SELECT vec_id, label, embedding AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
SELECT vec_id AS item, round(CAST(e[1] AS DOUBLE) / n, 6) AS first, true AS sound FROM u
""")
def q133_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of each unit vector, and whether the vector is sound."""
    rows = vectors.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.select("item", F.round(F.get("v", F.lit(0)), 6).alias("first"), studies.sound_vector(F.col("v"), 64).alias("sound"))


@register("""
WITH p AS (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL)
SELECT label AS item, round(max(CASE WHEN i = 1 THEN x END) / sqrt(sum(x * x)), 6) AS first FROM m GROUP BY label
""")
def q134_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of the normalised mean vector of each label."""
    rows = vectors.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("item", F.round(F.get("v", F.lit(0)), 6).alias("first"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("SELECT doc_id, text, lang, n_chars FROM documents")
def q135_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back under a schema."""
    path = _folder(spark, "json")
    readers.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return readers.json_lines(spark, path, "doc_id long, text string, lang string, n_chars long")


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def q136_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as headed CSV and read back under a schema."""
    path = _folder(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return readers.csv_table(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@register("""
WITH l AS (SELECT doc_id AS item_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT item_id, count(*) AS n_lines, CAST(sum(length(trim(text, ' '))) AS BIGINT) AS n_chars FROM l WHERE trim(text, ' ') <> '' AND (line % 10) / 10.0 >= 0.35 GROUP BY item_id
""")
def q137_recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents above a confidence, as a recogniser's payload gives them."""
    texts = F.split("text", "\n")
    payload = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), texts.alias("rec_texts"), F.transform(texts, lambda _, i: (i % 10) / 10.0).alias("rec_scores"))
    return readers.readable_lines(payload).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("text")).alias("n_chars"))


@register("""
SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE replace(text, chr(10), chr(10)) END AS text, doc_id % 3 = 0 AS corrected FROM documents
""")
def q138_corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, a third of them corrected by hand."""
    rows = table(spark, sf_dir, "documents")
    base = rows.select(F.col("doc_id").alias("item_id"), F.split("text", "\n").alias("rec_texts"))
    return readers.corrected_text(base, rows.where("doc_id % 3 = 0").select(F.col("doc_id").alias("item_id"), F.array(F.upper("lang")).alias("rec_texts")))


@register("SELECT label AS query, 'text' AS branch, vec_id AS item, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings WHERE vec_id % 4 <> 0")
def q139_long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score payloads with parallel arrays as rows, of items that search may return."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("s")).groupBy(F.col("label").alias("query"))
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("vec_id", "s"))).alias("x"))
    payload = lists.select("query", F.lit("text").alias("branch"), F.transform("x", lambda r: r["vec_id"]).alias("item_ids"), F.transform("x", lambda r: r["s"]).alias("scores"))
    flagged = readers.long_scores(payload).withColumn("search_enabled", F.when(F.col("item") % 4 == 0, F.lit(False)))
    return readers.enabled_items(flagged).select("query", "branch", "item", F.round("score", 6).alias("score"))


@register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def q140_published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two published versions of a table."""
    root = _folder(spark, "library")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    readers.publish({"nation": rows}, root, "v1")
    readers.publish({"nation": rows.where("n_nationkey < 10")}, root, "v2")
    return readers.published(spark, root, "nation")


@register("SELECT 'region.parquet' AS name, 1 AS n_files, true AS named")
def q141_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and hash of a whole file."""
    files = readers.whole_files(spark, sf_dir, "region.parquet")
    hashed = readers.directory_manifest(files).select("path", "sha256")
    named = F.col("item_id") == F.concat(F.lit("user_"), F.substring("sha256", 1, 12))
    return files.join(hashed, "path").groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.bool_and(named).alias("named"))


@register(f"""
WITH {RANKED_CTE}, r AS (SELECT query, string_agg(CAST(item AS VARCHAR), chr(10) ORDER BY rank) AS ids FROM ranked WHERE rank <= 20 GROUP BY query)
SELECT query, substr(sha256('p' || chr(10) || 'discovery' || chr(10) || ids), 1, 12) AS signature, query % 2 = 0 AS cached FROM r
""")
def q143_ranking_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the first twenty candidates, and which requests a cache can answer."""
    rows = _ranked(spark, sf_dir, 20).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("x"))
    ids = F.transform("x", lambda r: r["item"].cast("string"))
    signed = rows.select("query", studies.ranking_signature(ids, F.lit("p"), F.lit("discovery")).alias("signature"), F.lit(None).cast("string").alias("revision"))
    hits = studies.cache_hits(signed, signed.where("query % 2 = 0"), ["query", "signature", "revision"]).select("query", F.lit(True).alias("cached"))
    return signed.join(hits, "query", "left").select("query", "signature", F.coalesce("cached", F.lit(False)).alias("cached"))


@register("""
SELECT d.doc_id, round(coalesce(CAST(quality AS DOUBLE), 0.0), 6) AS confidence, round(ln(1 + n_chars) / 10, 6) AS chars, round(ln(1 + len(string_split(text, chr(10)))) / 8, 6) AS boxes FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q144_reading_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence aligned to every document, and the features of how it was read."""
    docs = table(spark, sf_dir, "documents")
    held = studies.aligned(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence")), "doc_id", "confidence")
    v = studies.ocr_features(F.col("confidence"), F.col("n_chars"), F.size(F.split("text", "\n")), F.lit(False))
    rows = docs.join(held, "doc_id").withColumn("v", v)
    return rows.select("doc_id", *(F.round(F.get("v", F.lit(i)), 6).alias(n) for i, n in enumerate(("confidence", "chars", "boxes"))))


@register("""
WITH q AS (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 17 = 0)
SELECT DISTINCT doc_id AS item_id FROM q
""")
def q145_review_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose route is not a pass or whose category is pending."""
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 0, "ocr_retry").alias("quality_route"))
    status = F.when(F.col("doc_id") % 17 == 0, "pending").otherwise("reviewed")
    return studies.review_required(quality, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), status.alias("taxonomy_review_status")))


@register("""
WITH q AS (SELECT DISTINCT conv_id AS query_id, first(text ORDER BY turn) AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
  r AS (SELECT *, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS k FROM q WHERE query_id % 5 <> 0 AND NOT regexp_matches(query, '[0-9]{9,}|@'))
SELECT query_id, count(*) OVER (PARTITION BY k) > 1 AS duplicated FROM r
""")
def q146_formal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed first questions that stay, and whether a text occurs twice."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    queue = rows.groupBy(F.col("conv_id").alias("query_id")).agg(F.min(F.struct("turn", "text")).alias("x")).select("query_id", F.col("x.text").alias("query"))
    reviews = queue.select("query_id", F.when(F.col("query_id") % 5 == 0, "excluded").otherwise("accepted").alias("decision"))
    return studies.formal_rows(queue, reviews).select("query_id", "duplicated")
