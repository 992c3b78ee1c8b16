"""Rules of reviews, judgments, pages and studies over the driver tables. Stated cases are in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import gates, studies
from tessera.plans.registry import register
from tessera.sources.tables import table
from tessera.sources.workspace import application_folder


@register("""
WITH r AS (SELECT doc_id, ['accepted', 'revised', 'no_answer', 'excluded', 'maybe'][doc_id % 5 + 1] AS decision, doc_id % 7 = 0 AS blank, doc_id % 3 AS n FROM documents)
SELECT doc_id, CASE WHEN decision = 'maybe' THEN 'unsupported_decision' WHEN decision <> 'excluded' AND blank THEN 'blank_query' WHEN decision IN ('accepted', 'revised') AND n = 0 THEN 'missing_relevant_ids'
  WHEN decision = 'no_answer' AND n > 0 THEN 'relevant_ids_without_answer' WHEN n = 2 THEN 'unknown_ids' END AS fault FROM r
""")
def q110_review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a review of every document: no id, its own, or one that is not known beside it."""
    i = F.col("doc_id")
    own = i.cast("string")
    decision = F.get(F.array(*map(F.lit, (*studies.DECISIONS, "maybe"))), (i % 5).cast("int"))
    ids = F.when(i % 3 == 0, "").when(i % 3 == 1, own).otherwise(F.concat(own, F.lit("; x"), own))
    fault = studies.review_fault(decision, F.when(i % 7 == 0, "  ").otherwise("who"), ids, F.array(own))
    return table(spark, sf_dir, "documents").select("doc_id", fault.alias("fault"))


@register("""
WITH r AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS known, ['accepted', 'reclassified', 'ocr_retry', 'quarantined', 'keep'][d.doc_id % 5 + 1] AS decision,
    CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang ELSE 'form' END AS category, d.doc_id % 3 = 0 AS odd FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN NOT known THEN 'unknown_item' WHEN decision = 'keep' THEN 'unsupported_decision' WHEN decision = 'reclassified' AND category NOT IN ('form', 'en', 'de') THEN 'missing_category'
  WHEN category <> '' AND category NOT IN ('form', 'en', 'de') THEN 'unsupported_category' WHEN odd THEN 'unsupported_tags' END AS fault FROM r
""")
def q111_quality_review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a quality review of every document; the labelled ones are known."""
    i = F.col("doc_id")
    decision = F.get(F.array(*map(F.lit, (*studies.QUALITY_DECISIONS, "keep"))), (i % 5).cast("int"))
    category, tags = F.when(i % 4 == 0, "").when(i % 4 == 1, F.col("lang")).otherwise("form"), F.when(i % 3 == 0, "blur;odd").otherwise("blur")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    fault = studies.quality_review_fault(F.coalesce("known", F.lit(False)), decision, category, tags, ("form", "en", "de"), ("blur", "skew"))
    return rows.select("doc_id", fault.alias("fault"))


@register("""
WITH r AS (SELECT event_id, event_id % 13 = 0 AS blank, event_id % 3 = 0 AS private, event_id % 4 = 0 AS category, event_id % 5 = 0 AS shared, event_id % 9 AS t, event_id % 11 AS v, event_id % 40 AS a FROM events),
  p AS (SELECT *, CASE WHEN t > 3 AND v > 3 THEN 1 ELSE 0 END AS miss, CASE WHEN a > 1 THEN 1 ELSE 0 END AS late FROM r)
SELECT event_id, CAST(CASE WHEN blank THEN 100 ELSE 0 END + CASE WHEN private THEN 80 ELSE 0 END + CASE WHEN category THEN 8 ELSE 0 END + CASE WHEN shared THEN 10 ELSE 0 END + 30 * miss + late * 2 * least(a - 1, 20) AS DOUBLE) AS score,
  concat_ws('|', CASE WHEN blank THEN 'blank_query' END, CASE WHEN private THEN 'privacy' END, CASE WHEN category THEN 'category' END, CASE WHEN shared THEN 'nonunique_evidence' END,
    CASE WHEN miss = 1 THEN 'both_branches_fail' END, CASE WHEN late = 1 THEN 'adaptive_not_top1' END) AS reasons FROM p
""")
def q114_review_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon the query of every event is to be looked at, and why."""
    i = F.col("event_id")
    flags = F.concat_ws(",", F.when(i % 3 == 0, "privacy_query_requires_manual"), F.when(i % 4 == 0, "category_needs_confirmation"), F.when(i % 5 == 0, "evidence_not_unique"))
    p = studies.review_priority(F.when(i % 13 == 0, "").otherwise("q"), flags, i % 9, i % 11, i % 40)
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.score", F.array_join("p.reasons", "|").alias("reasons"))


LINES_SQL = r"""
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
  own AS (SELECT DISTINCT doc_id, line FROM l WHERE length(line) BETWEEN 4 AND 60),
  f AS (SELECT line, count(*) AS df FROM own GROUP BY line)
"""
# Of an ordered list, the first and the first after it that neither holds nor is held by it.
TWO_SQL = """
  o AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM w),
  one AS (SELECT doc_id, line FROM o WHERE n = 1),
  two AS (SELECT o.doc_id, min_by(o.line, o.n) AS line FROM o JOIN one USING (doc_id) WHERE NOT contains(one.line, o.line) AND NOT contains(o.line, one.line) GROUP BY o.doc_id)
SELECT doc_id, concat_ws('|', one.line, two.line) AS chosen FROM one LEFT JOIN two USING (doc_id)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of 4 to 60 characters of every document, each with how many documents have it.

    Lines are counted by their 128-bit hash; the lines themselves meet the
    counts of those that several documents have, the others have one.
    """
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    own = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.char_length(x).between(4, 60)))
    each = docs.select("doc_id", F.explode(own).alias("line")).withColumn("key", F.unhex(F.md5("line")))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return each.join(shared, "key", "left").withColumn("df", F.coalesce("df", F.lit(1)))


@register(f"""
WITH {LINES_SQL}, w AS (SELECT doc_id, line, round((0.65 + doc_id % 7 * 0.05) * least(length(line), 24) / greatest(df, 1), 9) AS weight FROM own JOIN f USING (line)), {TWO_SQL.format(order="weight DESC, line")}
""")
def q115_chosen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of every document that stand as its evidence: sure, long and rare first, none inside another."""
    rows = _lines(spark, sf_dir).select(F.col("doc_id").alias("item"), F.col("line").alias("text"), (0.65 + F.col("doc_id") % 7 * 0.05).alias("confidence"), "df")
    return studies.chosen_evidence(rows).select(F.col("item").alias("doc_id"), F.array_join("evidence", "|").alias("chosen"))


@register(f"""
WITH {LINES_SQL}, w AS (SELECT o.doc_id, o.line, df FROM own o JOIN f USING (line) WHERE df <= 2 AND NOT EXISTS (SELECT 1 FROM own x WHERE x.doc_id = o.doc_id + 1 AND x.line = o.line)), {TWO_SQL.format(order="df, length(line) DESC, line")}
""")
def q155_distinctive_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rare lines of every document that the next document lacks, none inside another."""
    rows = _lines(spark, sf_dir)
    # Only a shared line can be the neighbour's too.
    near = rows.where("df > 1").select((F.col("doc_id") - 1).alias("doc_id"), "key", F.lit(True).alias("on_neighbour")).distinct()
    rows = rows.join(near, ["doc_id", "key"], "left").select(F.col("doc_id").alias("item"), F.col("line").alias("phrase"), "df", F.coalesce("on_neighbour", F.lit(False)).alias("on_neighbour"))
    return studies.distinctive_phrases(rows).select(F.col("item").alias("doc_id"), F.array_join("phrases", "|").alias("chosen"))


@register("""
WITH r AS (SELECT doc_id, quality, toxic, (doc_id % 20) / 20.0 AS c FROM labels)
SELECT doc_id, quality = 1 AND c >= 0.9 AND toxic <> 1 AS auto, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN quality <> 1 THEN 'no_relevant_candidate' END WHEN doc_id % 3 = 1 THEN CASE WHEN quality = 1 THEN 'marked_relevant' END
    ELSE 'unknown_decision' END AS pool_fault,
  CASE WHEN doc_id % 5 = 0 THEN 'pool_sha256' WHEN doc_id % 7 = 0 THEN 'retrieval_runs' WHEN doc_id % 11 = 0 THEN 'candidate_count' WHEN doc_id % 2 = 0 THEN 'reviewer_count' WHEN toxic = 1 THEN 'adjudicated'
    WHEN quality <> 1 THEN 'known_relevant_outside_pool' END AS absent_fault FROM r
""")
def q124_judgment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's review, the decision on a pool and the record of no answer for every labelled document, under their rules."""
    i, good, toxic = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    rows = table(spark, sf_dir, "labels").withColumns({
        "decision": F.when(good, "yes").otherwise("unsure"), "confidence": (i % 20) / 20.0, "uncertain_item_ids": F.when(toxic, F.array(i.cast("string"))),
        "pool_fault": studies.pool_judgment_fault(F.when(i % 3 == 0, "relevant_candidate_in_pool").when(i % 3 == 1, "no_relevant_candidate_in_pool").otherwise("other"), good),
    })
    record = {
        "pool_sha256": F.when(i % 5 == 0, "xyz").otherwise(F.sha2(i.cast("string"), 256)), "retrieval_runs": F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("bm25"))),
        "candidate_count": F.when(i % 11 == 0, 0).otherwise(5), "reviewer_count": F.when(i % 2 == 0, 1).otherwise(2), "adjudicated": ~toxic, "known_relevant_outside_pool": F.when(good, F.lit(False)),
    }
    return studies.sure_reviews(rows, ("yes", "no")).select("doc_id", "auto", "pool_fault", studies.no_answer_fault(record).alias("absent_fault"))


@register("SELECT true AS first, false AS second, count(*) AS n_items, sum(doc_id) AS ids FROM documents")
def q142_one_shot_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt of all documents can be claimed once; the second claim leaves the first one's rows."""
    path = f"{application_folder(spark)}/receipt-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "documents")
    first = studies.claim_once(documents.agg(F.count(F.lit(1)).alias("n_items"), F.sum("doc_id").alias("ids")), path)
    second = studies.claim_once(documents.agg(F.lit(0).alias("n_items"), F.lit(0).alias("ids")), path)
    return spark.read.parquet(path).select(F.lit(first).alias("first"), F.lit(second).alias("second"), "n_items", "ids")


@register("""
WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'visual_discovery' WHEN 1 THEN 'topic_discovery' ELSE 'visual_discovery' END AS route, event_id % 3 = 0 AS coloured,
    (event_id % 40) / 100.0 AS c, (event_id % 70) / 100.0 AS v, (event_id % 90) / 100.0 AS t, event_id % 17 = 0 AS exact FROM events)
SELECT event_id, CASE WHEN route = 'visual_discovery' AND coloured THEN c >= 0.18 WHEN route = 'visual_discovery' THEN v >= 0.35 ELSE exact OR t >= 0.44 END AS accepted FROM r
""")
def q152_discovery_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the browsing query of every event finds anything."""
    i = F.col("event_id")
    best = {"colour": (i % 40) / 100.0, "visual": (i % 70) / 100.0, "text": (i % 90) / 100.0}
    accepted = gates.discovery_accepted(F.when(i % 3 == 1, "topic_discovery").otherwise("visual_discovery"), F.when(i % 3 == 0, "blue"), best, F.when(i % 17 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "events").select("event_id", accepted.alias("accepted"))


@register("""
WITH r AS (SELECT event_id, concat_ws(';', CASE WHEN event_id % 2 = 0 THEN 'clear' END, CASE WHEN event_id % 3 = 0 THEN 'blur' END, CASE WHEN event_id % 5 = 0 THEN 'reflection' END, CASE WHEN event_id % 7 = 0 THEN 'tilt' END) AS t FROM events)
SELECT event_id, CASE WHEN t LIKE 'clear;%' THEN substr(t, 7) ELSE t END AS normal FROM r
""")
def q160_quality_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of every event in normal form: one name each, unknown ones dropped, clear alone only."""
    i = F.col("event_id")
    tags = F.concat_ws("; ", F.when(i % 2 == 0, "clear_scan"), F.when(i % 3 == 0, "blurry;blur"), F.when(i % 11 == 0, F.col("event_type")), F.when(i % 5 == 0, "glare,reflection"), F.when(i % 7 == 0, "perspective"))
    return table(spark, sf_dir, "events").select("event_id", studies.quality_tags(tags).alias("normal"))


@register("""
WITH q AS (SELECT p_partkey, 'Is the ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' under the table?' ELSE ' by the door?' END AS question FROM part)
SELECT p_partkey, question, CASE WHEN regexp_matches(question, '\\bred\\b') THEN regexp_replace(question, '\\bred\\b', 'blue') WHEN regexp_matches(question, '\\bgreen\\b') THEN regexp_replace(question, '\\bgreen\\b', 'yellow')
    WHEN p_partkey % 2 = 0 THEN replace(question, 'under', 'on top of') END AS query,
  CASE WHEN regexp_matches(question, '\\b(red|green)\\b') THEN 'color_substitution' WHEN p_partkey % 2 = 0 THEN 'relation_substitution' END AS kind FROM q
""")
def q162_near_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question about every part with one condition changed, read from its tags."""
    said = F.concat(F.lit("question= Is the  "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " under the table? ").otherwise(" by the door? "))
    rows = table(spark, sf_dir, "part").where("p_name IS NOT NULL").select("p_partkey", studies.tagged_question(F.array("p_brand", said)).alias("question"))
    near = studies.near_negative(F.col("question"), {"red": "blue", "green": "yellow"}, (("under", "on top of"), ("left", "right")))
    return rows.withColumn("n", near).select("p_partkey", "question", "n.query", "n.kind")


@register("""
WITH g AS (SELECT a, b, c FROM (VALUES (0.25::DOUBLE, 1.0::DOUBLE), (0.5, 2.0)) p(a, b), (VALUES (5.0::DOUBLE), (6.0), (7.0)) q(c)), d AS (SELECT least(1.0, n_chars / 4000.0) AS score, n_chars FROM documents)
SELECT a, b, c, count_if(score >= a AND n_chars >= 100 * b * c) AS n_kept FROM g, d GROUP BY a, b, c
""")
def q164_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each configuration of a grid keeps, in one pass; two of its fields move together."""
    grid = studies.configurations(spark, {"a": [0.25, 0.5], "b": [1, 2], "c": [5, 6, 7]}, paired=[("a", "b")]).collect()  # six rows, as stated above
    score, n = F.least(F.lit(1.0), F.col("n_chars") / 4000.0), F.col("n_chars")
    cell = lambda r: F.struct(*(F.lit(r[x]).alias(x) for x in ("a", "b", "c")), F.count_if((score >= r["a"]) & (n >= 100 * r["b"] * r["c"])).alias("n_kept"))
    return table(spark, sf_dir, "documents").agg(F.array(*map(cell, grid)).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")
