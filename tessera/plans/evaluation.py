"""Evaluation queries: ranking metrics, gates, selection, agreement, calibration, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import geometric_mean, sigmoid
from tessera.operators import gates, metrics, products, statistics
from tessera.plans.registry import register
from tessera.sources.tables import table
from tessera.sources.workspace import materialize

# Every ranking here is exact inner product of the stated query vectors against all others; same label is relevant.
RANKED_CTE = """
  s AS (
    SELECT q.vec_id AS query, q.label AS asked, v.vec_id AS item, v.label, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
    FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q CROSS JOIN embeddings v WHERE v.vec_id <> q.vec_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s),
  firsts AS (SELECT query, any_value(asked) AS asked, min(CASE WHEN label = asked THEN rank END) AS best_rank,
      max(CASE WHEN rank = 1 THEN score END) AS top1, max(CASE WHEN rank = 2 THEN score END) AS top2 FROM ranked GROUP BY query)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries (query, asked, v) and all items (item, label, v)."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("asked"), F.col("embedding").alias("v"))
    return asked, rows.where("vec_id is not null").select(F.col("vec_id").alias("item"), "label", F.col("embedding").alias("v"))


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """``(query, asked, item, label, score, rank)`` of the ``k`` best other rows of each query."""
    return products.best_products(*_sides(spark, sf_dir), k)


def _first_hits(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """The ``k`` best rows of each query and its ``k`` best rows of the same label, with their ranks among all."""
    return products.same_ranks(*_sides(spark, sf_dir), k)


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """``_first_hits`` for those who only ask whether a rank is beyond ``k``: such ranks are ``k`` + 1, and nothing is counted."""
    return products.best_products(*_sides(spark, sf_dir), k, same=True).withColumn("rank", F.coalesce("rank", F.lit(k + 1)))


def _relevant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query, n)``: how many other rows have the label of each query that has any."""
    asked, items = _sides(spark, sf_dir)
    asked = asked.select("query", F.col("asked").alias("label")).where("label is not null")
    held = items.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = items.groupBy(F.col("item").alias("query"), "label").agg(F.count(F.lit(1)).alias("own"))
    return asked.join(held, "label").join(own, ["query", "label"]).select("query", (F.col("n") - F.col("own")).alias("n")).where("n > 0")


def _firsts(rows: DataFrame) -> DataFrame:
    """``best_rank`` and the two best scores of ranked rows; ranks beyond the given rows are null."""
    return rows.groupBy("query").agg(
        F.max("asked").alias("asked"), F.min(F.when(F.col("label") == F.col("asked"), F.col("rank"))).alias("best_rank"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"),
    )


@register(f"""
WITH {RANKED_CTE},
  rel AS (SELECT query, count(*) AS n FROM ranked WHERE label = asked GROUP BY query),
  dcg AS (SELECT query, sum(1 / log2(rank + 1)) AS dcg FROM ranked WHERE rank <= 10 AND label = asked GROUP BY query),
  nd AS (SELECT query, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM rel LEFT JOIN dcg USING (query))
SELECT count(*) AS n_queries, round(avg(CASE WHEN best_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN best_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3,
  round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / best_rank, 0)), 6) AS mrr,
  (SELECT round(avg(ndcg), 6) FROM nd) AS ndcg_10 FROM firsts
""")
def q28_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of vector search by label."""
    rows = _first_hits(spark, sf_dir, 10)
    hit = F.coalesce(F.col("label") == F.col("asked"), F.lit(False))
    nd = metrics.ndcg_counted(rows.select("query", "rank", hit.alias("relevant")), _relevant_counts(spark, sf_dir)).agg(F.round(F.avg("ndcg"), 6).alias("ndcg_10"))
    main = _firsts(rows).agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(metrics.recall_at(1), 6).alias("recall_1"), F.round(metrics.recall_at(3), 6).alias("recall_3"),
        F.round(metrics.recall_at(10), 6).alias("recall_10"), F.round(metrics.mean_reciprocal_rank(), 6).alias("mrr"),
    )
    return main.crossJoin(nd)


GATED_CTE = f"""
  {RANKED_CTE},
  g AS (SELECT query, asked % 3 AS kind, asked % 4 <> 0 AS answerable, top1 >= 0.4 AS accepted, best_rank, top1, top1 - top2 AS margin FROM firsts)
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firsts(_ranked(spark, sf_dir, 10)).select(
        "query", (F.col("asked") % 3).alias("kind"), (F.col("asked") % 4 != 0).alias("answerable"), (F.col("top1") >= 0.4).alias("accepted"),
        "best_rank", "top1", (F.col("top1") - F.col("top2")).alias("margin"),
    )


@register(f"""
WITH {GATED_CTE}
SELECT CAST(kind AS BIGINT) AS kind, count(*) AS n_queries,
  round(coalesce(count_if(answerable AND best_rank <= 1) / nullif(count_if(answerable), 0), 0), 6) AS recall_1,
  round(coalesce(count_if(answerable AND best_rank <= 10) / nullif(count_if(answerable), 0), 0), 6) AS recall_10,
  round(coalesce(count_if(answerable AND accepted AND best_rank <= 1) / nullif(count_if(answerable), 0), 0), 6) AS product_recall_1,
  round(coalesce(count_if(answerable AND accepted) / nullif(count_if(answerable), 0), 0), 6) AS acceptance,
  round(coalesce(count_if(NOT answerable AND NOT accepted) / nullif(count_if(NOT answerable), 0), 0), 6) AS rejection,
  round(coalesce(count_if(NOT answerable AND accepted) / nullif(count_if(NOT answerable), 0), 0), 6) AS false_accept_rate,
  round(count_if((answerable AND accepted AND best_rank = 1) OR (NOT answerable AND NOT accepted)) / count(*), 6) AS end_to_end
FROM g GROUP BY kind
""")
def q29_gated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranker and product metrics by query kind, with acceptance by a score threshold."""
    out = metrics.gated_metrics(_gated(spark, sf_dir), "kind")
    names = ("recall_1", "recall_10", "product_recall_1", "acceptance", "rejection", "false_accept_rate", "end_to_end")
    return out.select(F.col("kind").cast("long").alias("kind"), "n_queries", *(F.round(n, 6).alias(n) for n in names))


@register(f"""
WITH {GATED_CTE}
SELECT query, round(top1, 6) AS top1, round(margin, 6) AS margin,
  round(1 / (1 + exp(-greatest(least(0.2 + 1.5 * (top1 - 0.3) / 0.2 - 0.7 * (margin - 0.05) / 0.05, 30), -30))), 6) AS probability FROM g
""")
def q30_open_set_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-set features of each query and a fixed logistic gate over them."""
    two = gates.top_two(_ranked(spark, sf_dir, 2), "score")
    p = gates.open_set_probability([F.col("top1"), F.col("margin")], [0.3, 0.05], [0.2, 0.05], [1.5, -0.7], 0.2)
    return two.select("query", F.round("top1", 6).alias("top1"), F.round("margin", 6).alias("margin"), F.round(p, 6).alias("probability"))


@register(f"""
WITH {RANKED_CTE},
  m AS (SELECT query, method, top1 AS text, top2 AS visual, 10 * top1 AS lexical FROM firsts CROSS JOIN (VALUES ('text'), ('visual'), ('bm25'), ('hybrid')) t(method)),
  j AS (SELECT query, coalesce(bool_or(score >= 0.3 AND label = asked), false) AS joint FROM ranked WHERE rank <= 10 GROUP BY query)
SELECT query, method, CASE method WHEN 'visual' THEN visual >= 0.45 WHEN 'text' THEN text >= 0.5 WHEN 'bm25' THEN lexical >= 4.0
  ELSE text >= 0.5 OR visual >= 0.45 OR lexical >= 4.0 END AS base_accepted, joint FROM m JOIN j USING (query)
""")
def q31_acceptance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base acceptance of every method and the guard that asks one row for joint evidence."""
    rows = materialize(_ranked(spark, sf_dir, 10), "best")
    joint = gates.joint_evidence(rows, F.col("score") >= 0.3, F.col("label") == F.col("asked"))
    methods = F.explode(F.array(*map(F.lit, ("text", "visual", "bm25", "hybrid")))).alias("method")
    first = _firsts(rows).select("query", "top1", "top2", methods)
    base = gates.base_accepts(F.col("method"), F.col("top1"), F.col("top2"), 10 * F.col("top1"))
    return first.join(joint, "query").select("query", "method", base.alias("base_accepted"), "joint")


@register(f"""
WITH {RANKED_CTE}, c AS (SELECT query, item, score, greatest(0.2, max(score) OVER (PARTITION BY query) - 0.14) AS cut FROM ranked)
SELECT query, item, round(score, 6) AS score FROM c WHERE score >= cut
""")
def q32_discovery_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within the discovery margin of their query's best."""
    asked, items = _sides(spark, sf_dir)
    cut = products.best_products(asked, items, 1).select("query", F.greatest(F.lit(0.2), F.col("score") - gates.MARGIN_VISUAL).alias("cut"))
    rows = products.near_products(asked.join(materialize(cut, "cuts"), "query"), items)
    return rows.select("query", "item", F.round("score", 6).alias("score"))


LISTWISE_CTE = f"""
  {RANKED_CTE}, c AS (SELECT query, item, rank, (score + 1) / 2 AS "full", score, asked, label FROM ranked WHERE rank <= 10)
"""


@register(f"""
WITH {LISTWISE_CTE},
  l0 AS (SELECT query, 'L0' AS method, item, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM c WHERE "full" >= 0.63),
  l1 AS (SELECT query, 'L1' AS method, item, "full", row_number() OVER (PARTITION BY query ORDER BY round("full", 9) DESC, rank) AS n FROM c),
  l2 AS (SELECT query, 'L2' AS method, item, row_number() OVER (PARTITION BY query ORDER BY round(0.5 / log2(rank + 1) + 0.5 * greatest(0, least(1, "full")), 9) DESC, rank) AS n FROM c)
SELECT query, method, item FROM l0 WHERE n = 1 UNION ALL SELECT query, method, item FROM l1 WHERE n = 1 AND "full" >= 0.63
UNION ALL SELECT query, method, item FROM l2 WHERE n = 1
""")
def q33_listwise_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First passing, best verified and blended candidate of each query."""
    rows = materialize(_ranked(spark, sf_dir, 10), "best").withColumn("full", (F.col("score") + 1) / 2)
    parts = [gates.listwise(rows, m).select("query", F.lit(m).alias("method"), "item") for m in ("L0", "L1", "L2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(f"""
WITH {LISTWISE_CTE},
  e AS (SELECT query, item, "full" AS g, unnest([1, 2, 3]) AS r, unnest([0.55, 0.6, 0.5]) AS thr, unnest([0.8, 0.9, 0.7]) AS fs, unnest([1.0, 2.0, 0.5]) AS w, unnest([true, false, true]) AS mandatory,
    unnest(["full", 1 - rank / 20.0, CASE WHEN label = asked THEN 0.9 ELSE 0.4 END]) AS raw FROM c),
  st AS (SELECT *, greatest(0.0, least(1.0, (raw - (2 * thr - fs)) / greatest(fs - (2 * thr - fs), 1e-9))) AS strength, raw >= thr AS passed FROM e),
  a AS (SELECT query, item, least(1.0, greatest(0.0, (max(g) - 0.35) / 0.25)) AS g, sum(w * strength) / sum(w) AS wm, exp(sum(w * ln(greatest(strength, 1e-6))) / sum(w)) AS wg,
    min(strength) AS weakest, count_if(NOT passed) = 0 AS accepted, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS ratio FROM st WHERE mandatory GROUP BY query, item)
SELECT query, item, accepted, round(weakest, 6) AS weakest, round(ratio, 6) AS ratio, round(0.20 * g + 0.35 * wm + 0.25 * wg + 0.20 * weakest, 6) AS coverage FROM a
""")
def q34_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement coverage of the first ten candidates of each query."""
    rows = _ranked(spark, sf_dir, 10).withColumn("full", (F.col("score") + 1) / 2)
    raw = (F.col("full"), F.lit(1.0) - F.col("rank") / 20.0, F.when(F.col("label") == F.col("asked"), 0.9).otherwise(0.4))
    fixed = ((0.55, 0.8, 1.0, True), (0.6, 0.9, 2.0, False), (0.5, 0.7, 0.5, True))
    needs = F.array(*(
        F.struct(F.lit(t).alias("thr"), F.lit(f).alias("fs"), F.lit(w).alias("weight"), F.lit(m).alias("mandatory"), x.alias("raw")) for (t, f, w, m), x in zip(fixed, raw, strict=True)
    ))
    each = rows.select("query", "item", F.col("full").alias("global_score"), F.explode(needs).alias("n")).select("query", "item", "global_score", "n.*")
    each = each.withColumn("strength", gates.strength(F.col("raw"), F.col("thr"), F.col("fs"))).withColumn("passed", F.col("raw") >= F.col("thr"))
    out = gates.coverage(each, keys=["query", "item"])
    return out.select(
        "query", "item", "accepted", F.round("weakest", 6).alias("weakest"), F.round("coverage_ratio", 6).alias("ratio"), F.round("coverage", 6).alias("coverage")
    )


SCORED_CTE = "d AS (SELECT l.doc_id, l.toxic, l.quality, least(1.0, d.n_chars / 4000.0) AS score, d.source, d.lang FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


SWEEP = """
  t AS (SELECT {by} score AS t, count_if(quality = 1) AS pos, count_if(quality = 0) AS neg FROM d GROUP BY ALL
    UNION ALL SELECT DISTINCT {by} unnest([0.0, 1.0]) AS t, 0, 0 FROM d),
  u AS (SELECT {by} t, sum(pos) AS pos, sum(neg) AS neg FROM t GROUP BY ALL),
  v AS (SELECT {by} t, sum(pos) OVER a AS tp, sum(neg) OVER a AS fp, sum(pos) OVER w AS p, sum(neg) OVER w AS n FROM u
    WINDOW a AS ({part} ORDER BY t DESC), w AS ({part})),
  points AS (SELECT {by} t AS threshold, (coalesce(tp / nullif(p, 0), 0) + coalesce((n - fp) / nullif(n, 0), 0)) / 2 AS balanced, coalesce((tp + n - fp) / nullif(p + n, 0), 0) AS accuracy FROM v)
"""


@register(f"""
WITH {SCORED_CTE}, {SWEEP.format(by="", part="")}
SELECT round(threshold, 6) AS threshold, round(balanced, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy FROM points
""")
def q35_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy and accuracy at every observed threshold."""
    out = statistics.threshold_sweep(_scored(spark, sf_dir), score="score", label="quality")
    return out.select(*(F.round(c, 6).alias(c) for c in ("threshold", "balanced_accuracy", "accuracy")))


@register(f"""
WITH {SCORED_CTE}, {SWEEP.format(by="lang,", part="PARTITION BY lang")}, o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(balanced, 9) DESC, round(accuracy, 9) DESC, threshold DESC) AS n FROM points)
SELECT lang, round(threshold, 6) AS threshold, round(balanced, 6) AS balanced_accuracy, round(accuracy, 6) AS accuracy FROM o WHERE n = 1
""")
def q36_best_threshold_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning threshold of each language by balanced accuracy, accuracy and size."""
    points = statistics.threshold_sweep(_scored(spark, sf_dir), score="score", label="quality", by=("lang",))
    best = statistics.best_by(points, F.round("balanced_accuracy", 9).desc(), F.round("accuracy", 9).desc(), F.col("threshold").desc(), by=("lang",))
    return best.select("lang", *(F.round(c, 6).alias(c) for c in ("threshold", "balanced_accuracy", "accuracy")))


@register(f"""
WITH {SCORED_CTE}, f AS (SELECT DISTINCT lang AS held FROM d), g AS (SELECT held, d.* FROM f JOIN d ON d.lang <> f.held),
  grid AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS t),
  m AS (SELECT held, t, avg(CASE WHEN (score >= t) = (quality = 1) THEN 1.0 ELSE 0 END) AS acc FROM g CROSS JOIN grid GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY round(acc, 9) DESC, t) AS n FROM m)
SELECT held, CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN (score >= t) = (quality = 1) THEN 1.0 ELSE 0 END), 6) AS held_accuracy, count(*) AS n FROM w JOIN d ON d.lang = w.held WHERE w.n = 1 GROUP BY held, t
""")
def q37_leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold chosen without a language, and its accuracy on that language.

    Hits of every threshold are counted per language once; what a held-out
    language leaves is the total minus its own share.
    """
    rows = _scored(spark, sf_dir)
    grid = F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4, 0.5)))).alias("t")
    right = ((F.col("score") >= F.col("t")) == (F.col("quality") == 1)).cast("long")
    own = rows.select("lang", "score", "quality", grid).groupBy("lang", "t").agg(F.sum(right).alias("hits"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("t")
    rest = own.withColumn("acc", (F.sum("hits").over(every) - F.col("hits")) / (F.sum("n").over(every) - F.col("n")))
    best = statistics.best_by(rest, F.round("acc", 9).desc(), F.col("t"), by=("lang",))
    return best.select(F.col("lang").alias("held"), F.col("t").alias("threshold"), F.round(F.col("hits") / F.col("n"), 6).alias("held_accuracy"), "n")


@register(f"""
WITH {RANKED_CTE},
  k AS (SELECT unnest([1, 2, 3, 5, 10, 20]) AS k),
  a AS (SELECT k, avg(CASE WHEN best_rank <= k THEN 1.0 ELSE 0 END) AS accuracy FROM firsts CROSS JOIN k GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, round(accuracy, 6) AS accuracy FROM a WHERE accuracy >= (SELECT max(accuracy) FROM a) - 0.03 - 1e-12 ORDER BY k LIMIT 1
""")
def q38_near_optimal_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest depth whose accuracy is within .03 of the best."""
    ks = F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 10, 20)))).alias("k")
    points = _firsts(_ranked(spark, sf_dir, 20)).select("best_rank", ks).groupBy("k").agg(F.avg(F.when(F.col("best_rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("accuracy"))
    return statistics.near_optimal(points, accuracy="accuracy", k="k").select(F.col("k").cast("long").alias("k"), F.round("accuracy", 6).alias("accuracy"))


@register(f"""
WITH {RANKED_CTE}, p AS (SELECT query, any_value(asked) AS gold, max(CASE WHEN rank = 1 THEN label END) AS predicted FROM ranked GROUP BY query),
  c AS (SELECT gold, predicted, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT gold AS label, sum(n) AS gn FROM c GROUP BY 1), sd AS (SELECT predicted AS label, sum(n) AS sn FROM c GROUP BY 1),
  j AS (SELECT label, coalesce(gn, 0) AS gn, coalesce(sn, 0) AS sn, coalesce((SELECT n FROM c WHERE c.gold = label AND c.predicted = label), 0) AS tp FROM g FULL JOIN sd USING (label))
SELECT CAST(label AS BIGINT) AS label, round(coalesce(tp / nullif(sn, 0), 0), 6) AS precision, round(coalesce(tp / nullif(gn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(gn + sn, 0), 0), 6) AS f1 FROM j
""")
def q39_per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 per label of nearest-neighbour classification."""
    rows = _ranked(spark, sf_dir, 1)
    out = metrics.per_class(metrics.confusion(rows, "asked", "label"))
    return out.select(F.col("label").cast("long").alias("label"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@register("""
WITH c AS (SELECT quality AS a, 1 - toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
  t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS agree FROM c),
  e AS (SELECT sum(r.n * k.n) AS products FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) r JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) k ON r.a = k.b)
SELECT CAST(n AS BIGINT) AS n, round(agree / n, 6) AS observed, round(products / (n * n), 6) AS expected, round((agree / n - products / (n * n)) / (1 - products / (n * n)), 6) AS kappa FROM t CROSS JOIN e
""")
def q40_cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two label columns read as two raters."""
    rows = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("other"))
    out = metrics.cohen_kappa(rows, "quality", "other")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@register(f"""
WITH {SCORED_CTE}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS c, avg(quality) AS ok FROM d GROUP BY 1)
SELECT round(sum(n * abs(ok - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b
""")
def q41_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error of a score against the quality label."""
    out = metrics.calibration_error(_scored(spark, sf_dir), "score", "quality")
    return out.select(F.round("ece", 6).alias("ece"), "n")


@register("""
WITH c AS (SELECT event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
  u AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM c),
  d AS (SELECT event_type, min(CASE WHEN upto >= ceil(0.5 * total) THEN value END) AS nearest_p50, min(CASE WHEN upto >= ceil(0.95 * total) THEN value END) AS nearest_p95 FROM u GROUP BY 1)
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(nearest_p50, 6) AS nearest_p50, round(nearest_p95, 6) AS nearest_p95
FROM events JOIN d USING (event_type) GROUP BY event_type, nearest_p50, nearest_p95
""")
def q42_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank quantiles of the event values by type."""
    rows = table(spark, sf_dir, "events")
    linear = rows.groupBy("event_type").agg(*statistics.linear_quantiles("value", 0.5, 0.95))
    near = statistics.nearest_rank_quantiles(rows, ["event_type"], "value", 0.5, 0.95)
    return linear.join(near, "event_type").select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "nearest_p50", "nearest_p95")))


@register()
def q43_grouped_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired difference of two outcomes with an interval from resampled sources."""
    rows = _scored(spark, sf_dir).withColumn("a", (F.col("score") > 0.5).cast("double")).withColumn("b", F.col("quality").cast("double"))
    return statistics.paired_bootstrap(rows, group="source", baseline="a", contender="b")


@register(f"""
WITH {RANKED_CTE}, t AS (SELECT query, max(CASE WHEN rank = 1 THEN (score + 1) / 2 END) AS p1, max(CASE WHEN rank = 2 THEN (score + 1) / 2 END) AS p2,
  max(CASE WHEN rank = 1 THEN label END) <> max(CASE WHEN rank = 2 THEN label END) AS disagree FROM ranked GROUP BY query)
SELECT query, round(least(1, 0.60 * (1 - p1) + 0.15 * (1 - (p1 - p2)) + 0.25 * CAST(disagree AS INT)), 6) AS priority FROM t
""")
def q44_review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active-learning priority from the two best candidates of each query."""
    p = (F.col("score") + 1) / 2
    rows = _ranked(spark, sf_dir, 2).groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, p)).alias("p1"), F.max(F.when(F.col("rank") == 2, p)).alias("p2"),
        (F.max(F.when(F.col("rank") == 1, F.col("label"))) != F.max(F.when(F.col("rank") == 2, F.col("label")))).alias("disagree"),
    )
    score = 0.60 * (1 - F.col("p1")) + 0.15 * (1 - (F.col("p1") - F.col("p2"))) + 0.25 * F.col("disagree").cast("int")
    return rows.select("query", F.round(F.least(F.lit(1.0), score), 6).alias("priority"))


@register(f"""
WITH {RANKED_CTE},
  b AS (SELECT query, CASE WHEN max(CASE WHEN rank = 1 THEN label END) = any_value(asked) THEN 'right' ELSE 'wrong' END AS before,
    CASE WHEN count_if(rank <= 3 AND label = asked) >= 2 THEN 'right' ELSE 'wrong' END AS after FROM ranked GROUP BY query)
SELECT before, after, count(*) AS n, before <> after AS changed FROM b GROUP BY before, after
""")
def q49_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How outcomes move from the first row to a majority of three."""
    name = lambda c: F.when(c, F.lit("right")).otherwise(F.lit("wrong"))
    rows = _ranked(spark, sf_dir, 3).groupBy("query").agg(
        name(F.max(F.when(F.col("rank") == 1, F.col("label"))) == F.max("asked")).alias("before"),
        name(F.count_if((F.col("rank") <= 3) & (F.col("label") == F.col("asked"))) >= 2).alias("after"),
    )
    return metrics.transitions(rows, "before", "after")


@register()
def q50_logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a balanced logistic model of the quality label."""
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), F.log1p(F.col("n_chars")).alias("logn"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("quality", F.col("quality").cast("double"))
    model = statistics.fit_logistic(rows, ["n", "logn"], "quality")
    return model.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("probability"))


@register(f"""
WITH {RANKED_CTE}, g AS (SELECT query, exp(avg(ln(greatest((score + 1) / 2, 1e-9)))) AS geo, avg((score + 1) / 2) AS mean, min((score + 1) / 2) AS weakest FROM ranked WHERE rank <= 5 GROUP BY query)
SELECT query, round(geo, 6) AS geometric, round(mean, 6) AS mean, round(weakest, 6) AS weakest, round(1 / (1 + exp(-mean)), 6) AS squashed FROM g
""")
def q57_candidate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric mean, mean and weakest of each query's five best scores."""
    rows = _ranked(spark, sf_dir, 5).groupBy("query").agg(F.collect_list((F.col("score") + 1) / 2).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return rows.select(
        "query", F.round(geometric_mean(F.col("v")), 6).alias("geometric"), F.round(mean, 6).alias("mean"), F.round(F.array_min("v"), 6).alias("weakest"),
        F.round(sigmoid(mean), 6).alias("squashed"),
    )


@register(f"""
WITH {RANKED_CTE}, n AS (SELECT query, top1 AS contender, top1 - 0.1 AS baseline, top1 - top2 AS margin, best_rank FROM firsts)
SELECT query, CASE WHEN baseline >= 0.5 THEN 'baseline_kept' WHEN query % 100 = 0 THEN 'too_few_requirements' WHEN best_rank IS NULL THEN 'requirement_missing'
  WHEN margin < 0.015 THEN 'relation_margin' WHEN contender < 0.63 THEN 'full_score' WHEN margin < 0.03 THEN 'margin' ELSE 'admitted' END AS decision FROM n
""")
def q58_guarded_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ordered check lets a contender replace the baseline."""
    rows = _firsts(_hits(spark, sf_dir, 2)).withColumn("m", F.col("top1") - F.col("top2"))
    decision = gates.guarded_admission({
        "baseline_accepted": F.col("top1") - 0.1 >= 0.5, "requirements": F.when(F.col("query") % 100 == 0, 1).otherwise(3), "compositional": F.lit(True),
        "missing": F.col("best_rank").isNull().cast("int"), "has_relation": F.lit(True), "relation_margin": F.col("m"), "full": F.col("top1"),
        "gain": F.lit(0.1), "margin": F.col("m"),
    })
    return rows.select("query", decision.alias("decision"))


@register()
def q83_multinomial_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of every vector by a multinomial model of the other folds."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"),
        F.pmod(F.xxhash64("vec_id"), F.lit(3)).cast("int").alias("fold"),
    )
    out = statistics.out_of_fold(rows, "fold", 3, lambda part: statistics.fit_multinomial(part, "x", "label"))
    return out.select("vec_id", "label", F.round(F.array_max(vector_to_array("probability")), 6).alias("confidence"))


@register()
def q84_text_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality probability of every labelled text by a forest over character n-grams."""
    from pyspark.ml.functions import vector_to_array

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("quality"))
    model, counted = statistics.fit_text_forest(rows, "text", "quality")
    return model.transform(counted).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("probability"))
