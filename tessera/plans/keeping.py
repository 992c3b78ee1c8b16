"""Constraints, migrations, frozen models, reporting streams, gate features and page evidence on the given tables."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import conditions, evidence, features, frozen, migration
from tessera.operators.contracts import GroupRule, RowRule, violations
from tessera.plans.building import SHARED_PAIRS, _pairs
from tessera.plans.registry import register
from tessera.sources.tables import table
from tessera.sources.workspace import application_folder
from tessera.streaming import reports

RANKED = SHARED_PAIRS.split("  g AS (")[0] + """
  k AS (SELECT query, doc_id AS item, relevant, overlap, cover, brief, english, unnest(['overlap', 'cover', 'brief']) AS method, unnest([overlap, cover, brief]) AS s FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY s DESC, item) AS rank FROM k),
"""


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumnRenamed("doc_id", "item")
    each = pairs.withColumn("m", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("s")) for m in ("overlap", "cover", "brief"))))).select("*", "m.*").drop("m")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query", "method").orderBy(F.col("s").desc(), "item")))


@register(RANKED + """
  t AS (SELECT query, list(overlap ORDER BY overlap DESC) AS o, list(brief ORDER BY brief DESC) AS b, min_by(item, rank) AS top_item, count(*) FILTER (overlap >= 0.2 AND english >= 1) AS aligned FROM r WHERE method = 'overlap' AND rank <= 10 GROUP BY query),
  f AS (SELECT query, min(rank) FILTER (method = 'overlap' AND relevant) AS rank_overlap, min(rank) FILTER (method = 'cover' AND relevant) AS rank_cover, min(rank) FILTER (method = 'brief' AND relevant) AS rank_brief FROM r GROUP BY query)
SELECT query, top_item, o[1] AS max_overlap, o[1] - coalesce(o[2], 0) AS margin_overlap, b[1] AS max_brief, b[1] - coalesce(b[2], 0) AS margin_brief, CAST(aligned AS INTEGER) AS aligned, rank_overlap, rank_cover, rank_brief FROM t JOIN f USING (query)
""")
def q184_gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best values, leads, aligned counts and relevant ranks of every benchmark text's rankings."""
    return features.gate_features(
        _rankings(spark, sf_dir), main="overlap", methods=("overlap", "cover", "brief"), signals=("overlap", "brief", "english"), aligned={"aligned": (("overlap", 0.2), ("english", 1.0))}
    ).drop("max_english", "margin_english")


@register(RANKED + "z AS (SELECT 1) SELECT query, method, item, CAST(rank AS INTEGER) AS rank FROM r WHERE method IN ('overlap', 'brief') AND rank <= 20")
def q185_candidate_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty of two rankings before any gate."""
    return features.snapshot(_rankings(spark, sf_dir), ("overlap", "brief")).select("query", "method", "item", "rank")


@register("""
WITH d AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'length as stated' AS rule, 'row' AS scope, CAST(doc_id AS VARCHAR) AS key, count(*) AS count FROM d WHERE NOT coalesce(n_chars = length(text), false) GROUP BY doc_id
UNION ALL SELECT 'labelled', 'row', CAST(doc_id AS VARCHAR), count(*) FROM d WHERE toxic IS NULL GROUP BY doc_id
UNION ALL SELECT 'good is not toxic', 'row', CAST(doc_id AS VARCHAR), count(*) FROM d WHERE quality = 1 AND toxic = 1 GROUP BY doc_id
UNION ALL SELECT 'one language a source', 'group', coalesce(source, 'null'), count(*) FROM d GROUP BY source HAVING count(DISTINCT lang) > 1
UNION ALL SELECT 'few toxic', 'group', coalesce(source, 'null') || '|' || coalesce(lang, 'null'), count(*) FROM d GROUP BY source, lang HAVING 10 * count(*) FILTER (toxic = 1) > count(toxic)
UNION ALL SELECT 'ids once', 'group', CAST(doc_id AS VARCHAR), count(*) FROM d GROUP BY doc_id HAVING count(*) > 1
""")
def q186_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every violation of six constraints on documents and labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = ~((F.col("quality") == 1) & (F.col("toxic") == 1))
    rules = [
        RowRule("length as stated", F.col("n_chars") == F.char_length("text")), RowRule("labelled", F.col("toxic").isNotNull()), RowRule("good is not toxic", F.col("toxic").isNull() | good),
        GroupRule("one language a source", ("source",), F.countDistinct("lang") <= 1), GroupRule("few toxic", ("source", "lang"), 10 * F.count_if(F.col("toxic") == 1) <= F.count("toxic")),
        GroupRule("ids once", ("doc_id",), F.count(F.lit(1)) == 1),
    ]
    return violations(rows, "doc_id", rules)


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[migration.Step]]:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("schema_version"), F.col("lang").alias("category"), F.array(F.col("source"), F.concat(F.lit("k"), F.col("n_chars").cast("string").substr(1, 1)), F.lit("raw")).alias("tags"))
    reviews = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("withheld").alias("decision"))
    steps = [
        migration.mapped(1, "category", {"de": "european", "fr": "european", "es": "european"}, "english"), migration.partitioned_tags(2, "tags", ("raw", "src0", "src1", "src2"), "more"),
        migration.overridden_by_review(3, "doc_id", "category", reviews, "decision"),
    ]
    return rows, steps


@register("""
SELECT d.doc_id, 4 AS schema_version, CASE WHEN l.toxic = 1 THEN 'withheld' WHEN lang IN ('de', 'fr', 'es') THEN 'european' WHEN lang IS NOT NULL THEN 'english' END AS category,
  array_to_string(list_filter([source, 'raw'], lambda x: x IN ('raw', 'src0', 'src1', 'src2')), ',') AS tags, lang AS was
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def q187_migrated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' manifest three versions on: mapped, tags parted, reviewed."""
    rows, steps = _manifest(spark, sf_dir)
    return migration.migrated(rows, steps).select("doc_id", "schema_version", "category", F.array_join("tags", ",").alias("tags"), F.col("was.v1").alias("was"))


@register("SELECT doc_id, 1 AS schema_version, lang AS category, array_to_string([source, 'k' || substr(CAST(n_chars AS VARCHAR), 1, 1), 'raw'], ',') AS tags FROM documents")
def q188_reset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migrated and reset: the first manifest."""
    rows, steps = _manifest(spark, sf_dir)
    return migration.reset(migration.migrated(rows, steps), steps).withColumn("tags", F.array_join("tags", ","))


@register("SELECT doc_id, true AS same, true AS refused FROM documents JOIN labels USING (doc_id)")
def q189_frozen_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored model says of every document what the fitted one said; with another fingerprint it is refused."""
    marks = F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("double")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("double").alias("length"), F.coalesce(marks, F.lit(0.0)).alias("marks"), F.col("quality").cast("double").alias("label"))
    ready = VectorAssembler(inputCols=["length", "marks"], outputCol="features").transform(rows)
    parameters = {"maxIter": 20, "regParam": 0.01}
    train = ready.where("doc_id % 3 <> 1")
    mark = frozen.fingerprint(train.drop("features"), parameters)
    fitted = LogisticRegression(**parameters).fit(train)
    path = f"{application_folder(spark)}/model-{uuid.uuid4().hex}"
    frozen.save(fitted, path, mark, spark)
    loaded = frozen.load(LogisticRegressionModel, path, mark, spark)
    try:
        frozen.load(LogisticRegressionModel, path, frozen.fingerprint(train.drop("features"), parameters | {"maxIter": 21}), spark)
        refused = False
    except ValueError:
        refused = True
    said = lambda model, name: model.transform(ready).select("doc_id", F.struct("rawPrediction", "probability", "prediction").alias(name))
    both = said(fitted, "a").join(said(loaded, "b"), "doc_id")
    return both.select("doc_id", (F.col("a") == F.col("b")).alias("same"), F.lit(refused).alias("refused"))


@register("""
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'an error event' WHEN value IS NULL OR value < 1 THEN 'value too small' END AS fault FROM events)
SELECT 'rows' AS kind, event_type AS what, count(*) AS n FROM e WHERE fault IS NULL GROUP BY event_type UNION ALL SELECT 'failures', fault, count(*) FROM e WHERE fault IS NOT NULL GROUP BY fault
UNION ALL SELECT 'progress', 'partial', count(*) FROM e
""")
def q190_reporting_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with failures and progress beside the rows; the stream is run twice, the second run replays the batch."""
    base, path = f"{application_folder(spark)}/reports-{uuid.uuid4().hex}", f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    fault = F.when(F.col("event_type") == "error", "an error event").when(F.col("value").isNull() | (F.col("value") < 1), "value too small")
    for run in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
        reports.start_reporting(stream, base, f"{base}-checkpoint{run}", fault).awaitTermination()
    part = lambda kind, what, n=F.count(F.lit(1)): reports.reported(spark, base, kind).groupBy(F.lit(kind).alias("kind"), F.col(what).alias("what")).agg(n.alias("n"))
    return part("rows", "event_type").unionByName(part("failures", "fault")).unionByName(part("progress", "status", F.sum("rows")))


@register("""
WITH c AS (SELECT client_id, name, city FROM (SELECT client_id, min(name) AS name, min(city) AS city FROM clients WHERE client_id IS NOT NULL GROUP BY client_id) WHERE length(name) >= 2 AND length(city) >= 2 AND NOT contains(name || city, '"')),
  p AS (SELECT client_id, name, city, unnest(['own', 'reversed']) AS page, unnest([name, reverse(name)]) AS shown FROM c),
  f AS (SELECT *, trim(regexp_replace(replace(lower(name), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')) AS a, trim(regexp_replace(replace(lower(city), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')) AS b,
    trim(regexp_replace(replace(lower('Name: ' || shown || ' Stadt - ' || city), 'ß', 'ss'), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')) AS t FROM p)
SELECT client_id, page, CAST(2 AS INTEGER) AS n_conditions, CAST(contains(t, a) AS INTEGER) + CAST(contains(t, b) AS INTEGER) AS n_matched, contains(t, a) AND contains(t, b) AS complete FROM f
""")
def q191_page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client's name and city, demanded together, on their own page and on one with the name reversed."""
    each = table(spark, sf_dir, "clients").where("client_id is not null").groupBy("client_id").agg(F.min("name").alias("name"), F.min("city").alias("city"))
    each = each.where('length(name) >= 2 and length(city) >= 2 and not contains(concat(name, city), "\\"")')
    query = F.concat(F.lit('哪份资料必须包含"'), "name", F.lit('"，并同时包含"'), "city", F.lit('"？'))
    shown = F.explode(F.array(F.struct(F.lit("own").alias("page"), F.col("name").alias("shown")), F.struct(F.lit("reversed").alias("page"), F.reverse("name").alias("shown"))))
    rows = each.withColumn("conditions", conditions.literal_conditions(query)).withColumn("p", shown)
    rows = rows.select("client_id", "p.page", "conditions", F.array(F.concat(F.lit("Name: "), "p.shown"), F.concat(F.lit("Stadt - "), "city")).alias("lines"))
    return evidence.with_evidence(rows).select("client_id", "page", "evidence.n_conditions", "evidence.n_matched", "evidence.complete")
