"""Intent routing, literal evidence and the generated reference corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import id_list, normalized_query, quoted_terms
from tessera.operators import corpus, intent, lexical
from tessera.plans.registry import register
from tessera.sources.tables import table
from tessera.sources.workspace import materialize

ENGLISH = intent.Lexicon(
    text_evidence=("token", "password"), visual_form=("table", "|"), visual_structure=("LICENSE", "License"), strong_literal=("2.0", "version"),
    visual_discovery=("the ", "der "), technical=("###",), question=("?",), entities=("The", "Der", "Les"),
)


def _has(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


@register(f"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, regexp_replace(text, '\\s+', '', 'g') AS b FROM documents),
  f AS (SELECT doc_id, {_has(ENGLISH.visual_structure)} AS structure, {_has(ENGLISH.strong_literal)} AS literal, {_has(ENGLISH.text_evidence)} AS evidence,
    {_has(ENGLISH.visual_form)} AS form, {_has(ENGLISH.technical)} AS technical, {_has(ENGLISH.visual_discovery)} AS topic,
    regexp_matches(q, '"[^"]{{2,}}"') AS quoted, length(b) BETWEEN 2 AND 12 AND regexp_matches(b, '^(The|Der|Les)') AS entity,
    length(q) BETWEEN 1 AND 16 AND regexp_matches(q, '^[A-Za-z0-9+#.\\-\\s]+$') AS short FROM s)
SELECT doc_id, CASE WHEN structure THEN CASE WHEN literal THEN 'mixed' ELSE 'visual_metadata' END WHEN evidence THEN 'text_evidence'
  WHEN quoted AND form THEN 'visual_metadata' WHEN NOT entity AND NOT (technical AND NOT form) AND topic THEN 'visual_discovery'
  WHEN entity THEN 'entity_exact' WHEN form THEN 'visual_metadata' WHEN short THEN 'topic_discovery' ELSE 'mixed' END AS route FROM f
""")
def q48_route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of every document's text under a small lexicon."""
    return table(spark, sf_dir, "documents").select("doc_id", intent.route(F.col("text"), ENGLISH).alias("route"))


@register("""
WITH b AS (SELECT item_id, text, CAST(item_id AS VARCHAR) || '; ' || CAST(item_id + 1 AS VARCHAR) || ', ' || CAST(item_id AS VARCHAR) || ';;' AS ids FROM benchmark)
SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalised, CAST(2 AS BIGINT) AS n_ids FROM b
""")
def q59_query_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised query texts and the distinct ids of a mixed-separator list."""
    n = F.col("item_id").cast("string")
    ids = F.concat(n, F.lit("; "), (F.col("item_id") + 1).cast("string"), F.lit(", "), n, F.lit(";;"))
    return table(spark, sf_dir, "benchmark").select("item_id", normalized_query(F.col("text")).alias("normalised"), F.size(id_list(ids)).cast("long").alias("n_ids"))


@register("""
SELECT doc_id, CAST(len(list_filter(list_distinct(regexp_extract_all(text, '"([^"]+)"', 1)), lambda t: length(trim(t)) >= 2)) AS BIGINT) AS n_quoted FROM documents
""")
def q60_quoted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct quoted terms every document holds."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(quoted_terms(F.col("text"))).cast("long").alias("n_quoted"))


# Families and colours of the generated corpus.
FAMILIES = (
    ("HARBOR", "crane", "harbor", "beside the warehouse"), ("DESERT", "pyramid", "desert", "behind the survey marker"),
    ("LAB", "microscope", "laboratory", "beside the safety cabinet"), ("FOREST", "bridge", "forest", "over the narrow river"),
    ("STATION", "train", "station", "under the platform clock"), ("ORBIT", "satellite", "space", "above the blue planet"),
    ("CLINIC", "scanner", "clinic", "next to the reception desk"), ("MUSEUM", "statue", "museum", "between two display cases"),
)
COLOURS = ("amber", "blue", "red", "green", "black")


def reference_pages(rows: DataFrame) -> DataFrame:
    """A generated page for every ``id``: the families in turn, each in every colour; forty ids give each pair once, codes stay unique beyond."""
    families = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("prefix", "object", "scene", "relation"), f, strict=True))) for f in FAMILIES))
    f, v = (F.floor(F.col("id") / 5) % len(FAMILIES)).cast("int"), (F.col("id") % 5 + 1).cast("int")
    made = rows.select("id", F.get(families, f).alias("f"), v.alias("v"), F.get(F.array(*map(F.lit, COLOURS)), v - 1).alias("colour"), f.alias("n"))
    code = F.format_string("%s-%03d", "f.prefix", F.col("v") + 5 * F.floor(F.col("id") / 40))
    text = F.format_string(
        "%s inspection record %d. Reference %s. A %s %s appears in the %s, %s. Maintenance note: verify panel %d before cycle %d.",
        F.initcap("f.scene"), "v", code, "colour", "f.object", "f.scene", "f.relation", F.col("n") + 1, "v",
    )
    return made.select("id", F.format_string("synthetic_%03d", F.col("id") + 1).alias("item"), code.alias("code"), "colour", "f.*", text.alias("text"))


def reference_queries(pages: DataFrame, answerable: Column, absent: Column, unused: str = "999") -> DataFrame:
    """``(query, text, relevant)``: requests for the ``answerable`` pages, and for ``absent`` ones under a code that no page has."""
    say = lambda code: F.format_string("Find the %s %s in the %s with reference %s.", "colour", "object", "scene", code)
    name = lambda kind: F.concat(F.lit(kind), F.col("id").cast("string")).alias("query")
    yes = pages.where(answerable).select(name("answerable_"), say(F.col("code")).alias("text"), F.col("item").alias("relevant"))
    no = pages.where(absent).select(name("no_answer_"), say(F.concat("prefix", F.lit(f"-{unused}"))).alias("text"), F.lit(None).cast("string").alias("relevant"))
    return yes.unionByName(no)


def reproduced(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Recall, rank and rejection of lexical search: a query is accepted when something scores and it names no unknown code."""
    # Words of the generated sentences recur in every page; a code has one page.
    best = lexical.bm25_best(asked, pages, 10, query_id="query", query_col="text", id_col="item", text_col="text", common=50)
    named = asked.select("query", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9]+-[0-9]{3,})\b"), F.lit(1))).alias("code"))
    missing = named.join(pages.select("code"), "code", "left_anti").select("query", F.lit(True).alias("missing")).distinct()
    first = best.join(asked, "query").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.min(F.when(F.col("item") == F.col("relevant"), F.col("rank"))).alias("rank"))
    rows = asked.select("query", "relevant").join(missing, "query", "left").join(first, "query", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))
    rows = rows.withColumn("accepted", (F.coalesce("top", F.lit(0.0)) > 0) & ~F.col("missing"))
    yes, found = F.col("relevant").isNotNull(), F.coalesce(F.col("rank") == 1, F.lit(False))
    return rows.agg(
        F.avg(F.when(yes, found.cast("double"))).alias("recall_1"), F.avg(F.when(yes, F.coalesce(1 / F.col("rank"), F.lit(0.0)))).alias("mrr"),
        F.avg(F.when(~yes, (~F.col("accepted")).cast("double"))).alias("rejection"),
        F.avg(((yes & F.col("accepted") & found) | (~yes & ~F.col("accepted"))).cast("double")).alias("end_to_end"),
        F.count(F.lit(1)).alias("n_queries"), F.count_if("missing").alias("missing_reference"),
    )


@register("""
SELECT 1.0::DOUBLE AS recall_1, 1.0::DOUBLE AS mrr, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE END AS rejection, 1.0::DOUBLE AS end_to_end, 2 * count(*) AS n_queries,
  count(*) AS missing_reference FROM supplier
""")
def q53_reference_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search over a page for every supplier, asked for under its code, which leads to it, and under an unknown one, which leads to none."""
    # A small file is one task; the pages made of it are not, and they are read several times.
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).repartition(spark.sparkContext.defaultParallelism, "id")
    pages = materialize(reference_pages(ids), "pages")
    return reproduced(pages, reference_queries(pages, F.lit(True), F.lit(True), unused="000"))


@register("""
SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), '(?i)身份证|公民身份号码|居民身份证|\\bidentity card\\b|\\bid card\\b') THEN 'table_form_ticket' ELSE '' END AS category,
  CASE WHEN category <> '' AND category <> lang THEN 'category_review' ELSE 'pass' END AS route FROM documents
""")
def q61_suggested_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category each document's wording suggests, and where it goes if it has another."""
    rows = table(spark, sf_dir, "documents").withColumn("category", corpus.suggested_category(F.col("text")))
    return rows.select("doc_id", "category", corpus.category_checked(F.lit("pass"), F.col("lang"), F.col("category")).alias("route"))
