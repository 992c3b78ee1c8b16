"""Requests put together from table rows: their literal conditions, routes and guards. Stated cases are in the tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import conditions, corpus, evidence, explain, gates, intent, literals, studies
from tessera.plans.evaluation import RANKED_CTE, _ranked
from tessera.plans.registry import register
from tessera.sources.tables import table


def _either(number: Column, *values: Column | str | None) -> Column:
    """The value whose place is ``number``."""
    return reduce(lambda c, nv: c.when(number == nv[0], nv[1]), enumerate(values[1:], 1), F.when(number == 0, values[0]))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a name and the number of its kind of request."""
    return table(spark, sf_dir, "items").where("name IS NOT NULL")


# ---- literal conditions

ORDER_SQL = "SELECT *, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS said, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code FROM orders"


def _order_requests(spark: SparkSession, sf_dir: str, day: Column, *, spread: bool = False) -> DataFrame:
    """Orders with a request for the paper of their number and ``day``; ``spread`` deals them out over all cores."""
    code = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    if spread:
        orders = orders.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return orders.select("o_orderkey", "o_orderdate", code.alias("code"), F.concat(F.lit("找出编号为"), code, F.lit("、日期为"), F.date_format(day, "y年M月d日"), F.lit("的传真页。")).alias("query"))


@register(f"""
WITH o AS ({ORDER_SQL})
SELECT 'order' AS asked, o_orderkey AS id, level, CASE WHEN level = 'basic' THEN said ELSE said || '|' || code END AS labels,
  CASE WHEN level = 'basic' THEN 'structured_date' ELSE 'structured_date|structured_identifier' END AS sources FROM o, (VALUES ('basic'), ('structured'), ('explicit')) l(level)
UNION ALL SELECT 'customer', c_custkey, 'explicit', c_name || '|' || c_mktsegment, 'explicit_required|explicit_required' FROM customer
""")
def q85_literal_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of a request for every order at each level, and of a demand for both values of every customer."""
    # Every order is read once for all levels; a small file is one task, so its rows are dealt out first.
    orders = _order_requests(spark, sf_dir, F.col("o_orderdate"), spread=True)
    orders = orders.select(F.lit("order").alias("asked"), F.col("o_orderkey").alias("id"), F.inline(conditions.leveled_conditions(F.col("query"))))
    both = F.concat(F.lit("哪份资料必须包含“"), "c_name", F.lit("”，并同时包含“"), "c_mktsegment", F.lit("”？"))
    customers = table(spark, sf_dir, "customer").select(F.lit("customer").alias("asked"), F.col("c_custkey").alias("id"), F.lit("explicit").alias("level"), conditions.literal_conditions(both).alias("c"))
    joined = lambda field: F.array_join(F.transform("c", lambda x: x[field]), "|")
    return orders.unionByName(customers.select("asked", "id", "level", joined("label").alias("labels"), joined("source").alias("sources")))


@register("SELECT o_orderkey, 2 AS n_conditions, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n_matched, o_orderkey % 3 <> 0 AS complete FROM orders")
def q86_literal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conditions the page of every order meets: dates come in four forms, every third request has another day."""
    day = F.col("o_orderdate")
    rows = _order_requests(spark, sf_dir, F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 1)).otherwise(day))
    form = _either(F.col("o_orderkey") % 4, F.date_format(day, "M/d/yyyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MMMM d, yyyy"), F.date_format(day, "y年M月d日"))
    rows = rows.withColumns({"page": F.array(F.concat(F.lit("No "), "code"), F.concat(F.lit("Date: "), form)), "c": conditions.literal_conditions(F.col("query"), "structured")})
    return evidence.with_evidence(rows, conditions="c", lines="page", level="structured", out="e").select("o_orderkey", "e.n_conditions", "e.n_matched", "e.complete")


@register("""
WITH r AS (SELECT c_custkey, level, c_custkey % 4 AS n FROM customer, (VALUES ('structured'), ('explicit')) l(level) WHERE c_mktsegment IS NOT NULL AND c_name IS NOT NULL)
SELECT c_custkey, level, n = 2 OR (n = 0 AND level = 'explicit') AS eligible,
  CASE WHEN n = 0 AND level = 'explicit' THEN 'explicit_named_discovery_contract_v19_2' WHEN n = 2 AND level = 'explicit' THEN 'high_precision_structured_contract'
    WHEN n = 2 THEN 'identifier_plus_additional_condition_contract' WHEN n = 3 THEN 'necessary_condition_extraction_incomplete' ELSE 'no_high_precision_literal_contract' END AS reason,
  CASE WHEN n = 3 THEN 'structured_identifier' ELSE '' END AS missing FROM r
""")
def q87_override_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether literal evidence may override the ranking of a request for every customer."""
    segment, say = F.col("c_mktsegment"), F.lit
    query = _either(
        F.col("c_custkey") % 4, F.concat(say("有哪些文档讨论 "), segment, say(" 的宣传方案？")), segment,
        F.concat(say("哪份资料必须包含“"), "c_name", say("”，并同时包含“"), segment, say("”？")), F.concat(say("哪一页有编号？"), segment),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", query.alias("query")).where("query IS NOT NULL")
    parts = []
    for level in ("structured", "explicit"):
        read = rows.withColumns({"level": F.lit(level), "conditions": conditions.literal_conditions(F.col("query"), level)})
        parts.append(conditions.override_eligibility(read, "query", level, out="e"))
    return parts[0].unionByName(parts[1]).select("c_custkey", "level", "e.eligible", "e.reason", F.array_join("e.missing", "|").alias("missing"))


@register("""
SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'both' END AS item, CASE WHEN c_custkey % 2 = 0 THEN 2 END AS rank, c_custkey % 2 = 0 AS accepted FROM customer
WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL
""")
def q88_literal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page that holds both values of a customer; every second customer has pages with one of them only."""
    rows = table(spark, sf_dir, "customer").where("c_name IS NOT NULL AND c_mktsegment IS NOT NULL")
    query = F.concat(F.lit("哪份资料必须包含“"), "c_name", F.lit("”，并同时包含“"), "c_mktsegment", F.lit("”？"))
    page = lambda rank, item, lines: F.struct(F.lit(rank).alias("rank"), F.lit(item).alias("item"), lines.alias("lines"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.array("c_name", "c_mktsegment")).otherwise(F.array("c_mktsegment"))
    pages = F.explode(F.array(page(1, "name", F.array("c_name")), page(2, "both", second), page(3, "segment", F.array("c_mktsegment"))))
    each = rows.select(F.col("c_custkey").alias("query_id"), query.alias("query"), pages.alias("p")).select("query_id", "query", "p.*")
    return evidence.select_literal(each, level="explicit", fuzzy=0.84)


# ---- routes

KEYWORD_SQL = "length(trim(regexp_replace(name, '\\s+', ' ', 'g'))) BETWEEN 1 AND 16 AND regexp_matches(name, '^[A-Za-z0-9+#.\\-\\s]+$')"


def _routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of request for items."""
    name, say = F.col("name"), F.lit
    query = _either(
        F.col("item_id") % 6, F.concat(say("蓝色"), name), F.concat(say("哪张图片上写着"), name), F.concat(say("找带印章的"), name), F.concat(say("白板写着"), name), name,
        F.concat(say("如何设计"), name, say("？")),
    )
    return _named(spark, sf_dir).select("item_id", "name", query.alias("query"))


ROUTE_SQL = f"CASE item_id % 6 WHEN 0 THEN 'visual_discovery' WHEN 1 THEN 'text_evidence' WHEN 2 THEN 'visual_metadata' WHEN 4 THEN CASE WHEN {KEYWORD_SQL} THEN 'topic_discovery' ELSE 'mixed' END ELSE 'mixed' END"


@register(f"SELECT item_id, {ROUTE_SQL} AS route FROM items WHERE name IS NOT NULL")
def q92_route_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of a request for every item."""
    return _routed_requests(spark, sf_dir).select("item_id", intent.route(F.col("query")).alias("route"))


@register("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'visual_metadata' WHEN 1 THEN 'mixed' WHEN 2 THEN 'text_evidence' ELSE 'visual_metadata' END AS route FROM events WHERE event_type IS NOT NULL
""")
def q48b_route_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of requests for events, whose words stand apart."""
    kind, say = F.col("event_type"), F.lit
    query = _either(
        F.col("event_id") % 4, F.concat(say("“"), kind, say("” 照片")), F.concat(say("白板 写着 "), kind), F.concat(say("提到 "), kind, say(" 的 页面")), F.concat(say("流程图  "), kind)
    )
    return table(spark, sf_dir, "events").where("event_type IS NOT NULL").select("event_id", intent.route(query).alias("route"))


@register("""
WITH i AS (SELECT item_id, replace(name, ' ', '') AS tight FROM items WHERE regexp_matches(name, '^[A-Za-z]+( [A-Za-z]+)*$'))
SELECT item_id, CASE WHEN item_id % 4 = 3 THEN '王小' || substr('一二三四五六七八九十', CAST(1 + item_id % 10 AS INTEGER), 1) END AS entity, CASE WHEN item_id % 4 = 0 THEN 'blue' END AS colour, false AS pure_colour,
  CASE item_id % 4 WHEN 0 THEN '蓝色' || tight WHEN 1 THEN tight WHEN 2 THEN '昨晚收到|' || tight ELSE '王小' || substr('一二三四五六七八九十', CAST(1 + item_id % 10 AS INTEGER), 1) END AS topics,
  CASE WHEN item_id % 4 = 2 THEN '昨晚' ELSE '' END AS times FROM i
""")
def q93_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, colours, topics and relative times in a request for every item of plain words."""
    name, say, q = F.col("name"), F.lit, F.col("query")
    query = _either(
        F.col("item_id") % 4, F.concat(say("找蓝色"), name), F.concat(say("查找标题里有"), name, say("的文档")), F.concat(say("找昨晚收到的"), name, say("截图")), F.concat(say("查找"), _person(), say("的资料"))
    )
    rows = _named(spark, sf_dir).where(name.rlike("^[A-Za-z]+( [A-Za-z]+)*$")).select("item_id", query.alias("query"))
    return rows.select(
        "item_id", intent.strict_entity(q).alias("entity"), intent.colour_intent(q).alias("colour"), intent.is_pure_colour(q).alias("pure_colour"),
        F.array_join(intent.topic_terms(q), "|").alias("topics"), F.array_join(intent.temporal_terms(q), "|").alias("times"),
    )


def _person() -> Column:
    """One of ten names for an item."""
    return F.concat(F.lit("王小"), F.substring(F.lit("一二三四五六七八九十"), (1 + F.col("item_id") % 10).cast("int"), F.lit(1)))


PERSON_SQL = "'王小' || substr('一二三四五六七八九十', CAST(1 + item_id % 10 AS INTEGER), 1)"


@register(f"""
WITH r AS (SELECT item_id, item_id % 4 AS n, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, {KEYWORD_SQL} AS short, {PERSON_SQL} AS person FROM items WHERE name IS NOT NULL)
SELECT item_id, CASE WHEN n IN (0, 1) THEN 'visual_discovery' WHEN n = 2 AND short THEN 'topic_discovery' WHEN n = 2 THEN 'mixed' ELSE 'entity_exact' END AS route, n <> 3 AND (n <> 2 OR short) AS exploratory,
  CASE n WHEN 0 THEN '蓝色' || name || '，主体内容必须匹配，同时要求以蓝色为主要色调，具有大面积明显蓝色区域的真实图片' WHEN 1 THEN '茂密的绿色森林，树木、山林和自然风景的真实照片' WHEN 2 THEN name
    ELSE '查找' || person || '的资料' END AS search_query, CASE WHEN n = 3 THEN person END AS entity FROM r
""")
def q94_search_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, mode, entity and search text of a request for every item."""
    name = F.trim(F.regexp_replace("name", r"\s+", " "))
    query = _either(F.col("item_id") % 4, F.concat(F.lit("蓝色"), name), F.concat(F.lit("森林 "), name), name, F.concat(F.lit("查找"), _person(), F.lit("的资料")))
    return _named(spark, sf_dir).select("item_id", intent.search_intent(query).alias("i")).select("item_id", "i.route", "i.exploratory", "i.search_query", "i.entity")


ROUTES = ("text_evidence", "visual_metadata", "visual_discovery", "topic_discovery", "entity_exact", "mixed")
ROUTE_NAMES = "['text_evidence', 'visual_metadata', 'visual_discovery', 'topic_discovery', 'entity_exact', 'mixed']"


def _one_of(names: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), (number % len(names)).cast("int"))


@register(f"""
WITH r AS (SELECT event_id, ['text', 'visual', 'quality_hybrid', 'reranker'][event_id % 4 + 1] AS method, {ROUTE_NAMES}[event_id // 4 % 6 + 1] AS route FROM events),
  e AS (SELECT *, route IN ('visual_discovery', 'topic_discovery') AS x FROM r)
SELECT event_id, method <> 'visual' AS text,
  CASE WHEN method IN ('text', 'visual') THEN false WHEN route IN ('entity_exact', 'text_evidence', 'visual_discovery', 'topic_discovery', 'mixed') THEN true ELSE method = 'quality_hybrid' END AS bm25,
  CASE WHEN method = 'text' THEN false WHEN method = 'visual' THEN true ELSE route NOT IN ('entity_exact', 'text_evidence', 'topic_discovery') END AS visual FROM e
""")
def q95_search_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches the search of every event needs, by method and route."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", _one_of(("text", "visual", "quality_hybrid", "reranker"), i).alias("method"), _one_of(ROUTES, F.floor(i / 4)).alias("route"))
    return rows.select("event_id", intent.branches(F.col("method"), F.col("route"), F.col("route").isin("visual_discovery", "topic_discovery")).alias("b")).select("event_id", "b.*")


NEEDS = ("needs_literal_text", "needs_visual_semantics", "needs_layout_structure", "needs_exact_entity", "needs_topic_discovery")
NEED_SQL = """CASE WHEN needs_exact_entity THEN 'entity_exact' WHEN needs_literal_text AND (needs_visual_semantics OR needs_layout_structure) THEN 'mixed'
  WHEN needs_layout_structure THEN 'visual_metadata' WHEN needs_visual_semantics THEN 'visual_discovery' WHEN needs_topic_discovery THEN 'topic_discovery'
  WHEN needs_literal_text THEN 'text_evidence' ELSE 'mixed' END"""
BITS = ", ".join(f"event_id >> {i} & 1 = 1 AS {n}" for i, n in enumerate(NEEDS))


@register(f"WITH n AS (SELECT event_id, {BITS} FROM events) SELECT event_id, {NEED_SQL} AS route FROM n")
def q96_evidence_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of what every event's request needs."""
    needs = {n: F.shiftright("event_id", i).bitwiseAND(F.lit(1)) == 1 for i, n in enumerate(NEEDS)}
    return table(spark, sf_dir, "events").select("event_id", intent.evidence_route(needs).alias("route"))


@register(f"""
WITH r AS (SELECT item_id, name, item_id % 2 = 0 AS free, item_id % 3 <> 0 AS ambiguous, ['visual_discovery', 'mixed', 'topic_discovery'][item_id // 3 % 3 + 1] AS rule,
    ['text_evidence', 'mixed', 'entity_exact', NULL, 'visual_discovery'][item_id // 2 % 5 + 1] AS model FROM items WHERE name IS NOT NULL),
  g AS (SELECT *, CASE WHEN free AND ((rule = 'visual_discovery' AND model IN ('text_evidence', 'mixed')) OR (rule = 'mixed' AND model = 'text_evidence')) THEN 'preserve_visual_route_without_literal_requirement'
    WHEN model = 'entity_exact' AND length(regexp_replace(name, '\\s+', '', 'g')) + CASE WHEN free THEN 4 ELSE 5 END > 16 THEN 'reject_entity_route_for_long_compound_query' END AS why FROM r)
SELECT item_id, CASE WHEN NOT ambiguous OR model IS NULL OR why IS NOT NULL THEN rule ELSE model END AS route,
  CASE WHEN NOT ambiguous THEN 'rule' WHEN model IS NULL THEN 'rule_fallback' WHEN why IS NOT NULL THEN 'rule_guard' ELSE 'llm' END AS source, CASE WHEN ambiguous AND model IS NOT NULL THEN why END AS reason FROM g
""")
def q97_hybrid_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and model routes of every item's request brought together under the guards."""
    i = F.col("item_id")
    query = F.concat(F.when(i % 2 == 0, "白色列车").otherwise("标题里写有"), "name")
    model = _either(F.floor(i / 2) % 5, "text_evidence", "mixed", "entity_exact", None, "visual_discovery")
    h = intent.hybrid_route(query, _one_of(("visual_discovery", "mixed", "topic_discovery"), F.floor(i / 3)), i % 3 != 0, model)
    return _named(spark, sf_dir).select("item_id", h.alias("h")).select("item_id", "h.*")


@register(f"""
SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'explicit_compound_evidence_missed_by_rule' WHEN 1 THEN CASE WHEN {KEYWORD_SQL} THEN '' ELSE 'rule_route_mixed' END WHEN 2 THEN 'rule_route_mixed'
  ELSE 'rule_route_mixed|probable_person_lookup_missed_by_rule' END AS reasons FROM items WHERE regexp_matches(name, '^[A-Za-z ]+$')
""")
def q98_route_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a model is asked about the route of every item's request."""
    name, say, q = F.col("name"), F.lit, F.col("query")
    query = _either(F.col("item_id") % 4, F.concat(say("哪份"), name, say("右下角盖了红色印章？")), name, F.concat(say("材料里有没有"), name), F.concat(say("材料里有没有"), _person(), say("？")))
    rows = _named(spark, sf_dir).where(name.rlike("^[A-Za-z ]+$")).select("item_id", query.alias("query"))
    return rows.select("item_id", F.array_join(intent.ambiguity(q, intent.route(q)), "|").alias("reasons"))


@register("SELECT item_id, CASE item_id % 4 WHEN 3 THEN 'visual_discovery' WHEN 2 THEN 'visual_discovery' ELSE 'entity_exact' END AS route FROM items WHERE regexp_matches(name, '^[A-Za-z ]+$') AND item_id < 100000000")
def q98b_recovered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons, codes and plain scenes the first rules miss, in a request for every item."""
    code = F.concat(F.lit("材料中有没有ZX-"), F.col("item_id").cast("string"), F.lit("？"))
    scene = F.concat(F.lit("我记得一张图中"), _person(), F.lit("正把锅抛起，旁边有火苗。"))
    query = _either(F.col("item_id") % 4, F.concat(F.lit("材料里有没有"), _person(), F.lit("？")), code, scene, F.concat(F.lit("森林 "), "name"))
    # Numbers of more than eight digits are no code.
    return _named(spark, sf_dir).where(F.col("name").rlike("^[A-Za-z ]+$") & (F.col("item_id") < 100_000_000)).select("item_id", intent.calibrated_route(query).alias("route"))


@register(f"""
WITH r AS (SELECT event_id, {ROUTE_NAMES}[event_id % 6 + 1] AS old, {ROUTE_NAMES}[event_id // 6 % 6 + 1] AS new, CASE event_id // 36 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c, event_id % 5 = 0 AS named FROM events),
  d AS (SELECT *, old IN ('visual_metadata', 'visual_discovery', 'mixed') AND new NOT IN ('visual_metadata', 'visual_discovery', 'mixed') AS drops FROM r),
  g AS (SELECT *, CASE WHEN old NOT IN ('topic_discovery', 'visual_discovery') AND new IN ('topic_discovery', 'visual_discovery') THEN 'preserve_factual_acceptance'
    WHEN new = 'entity_exact' AND NOT named THEN 'entity_exact_without_strict_term' WHEN coalesce(c, false) AND drops THEN 'compositional_candidate_removes_legacy_branch'
    WHEN drops THEN 'candidate_removes_legacy_branch' END AS reason FROM d)
SELECT event_id, CASE WHEN reason IS NULL THEN new ELSE old END AS route, reason FROM g
""")
def q99_transition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New routes of every event's request that would weaken what the old ones secure are turned down."""
    i = F.col("event_id")
    asked = F.when(i % 5 == 0, "查找王小一的资料").otherwise("帮我找一个可能的人名")
    guard = intent.transition_guard(F.lit("quality_hybrid"), _one_of(ROUTES, i), _one_of(ROUTES, F.floor(i / 6)), _either(F.floor(i / 36) % 3, F.lit(True), F.lit(False)), intent.strict_entity(asked))
    return table(spark, sf_dir, "events").select("event_id", guard.alias("g")).select("event_id", "g.*")


# ---- guards over rankings

GUARD_SQL = f"""WITH {RANKED_CTE}, r AS (SELECT query, item, rank, score, query // 50 % 4 AS n, (item % 20) / 10.0 AS dense, CAST(item % 11 AS DOUBLE) AS lexical, item % 29 = 0 AS quoted FROM ranked WHERE rank <= 30),
  c AS (SELECT query, n, count_if(quoted) AS quoted, count_if(dense >= 0.5 AND lexical >= 4) AS aligned, count_if(coalesce(score, 0) >= 0.34) AS seen,
    count_if(score >= 0.34 AND dense >= 0.5 AND lexical >= 4) AS met FROM r WHERE rank <= 10 GROUP BY query, n),"""


@register(GUARD_SQL + """
  told AS (SELECT query, CASE n WHEN 0 THEN CASE WHEN quoted = 0 THEN 0 ELSE aligned + quoted END WHEN 1 THEN aligned + quoted WHEN 2 THEN seen + quoted ELSE met + quoted END AS signal,
    CASE n WHEN 0 THEN CASE WHEN quoted = 0 THEN 'complete_quoted_evidence_count' ELSE 'aligned_text_bm25_candidate_count' END WHEN 1 THEN 'aligned_text_bm25_candidate_count'
      WHEN 2 THEN 'visual_metadata_candidate_count' ELSE 'aligned_visual_text_candidate_count' END AS signal_name FROM c)
SELECT query, signal >= 1 AS accepted, signal_name, signal FROM told
""")
def q100_route_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a route must meet on one of the ten nearest vectors of a query."""
    n = F.floor(F.col("query") / 50) % 4
    text = _either(n, "查找“年度报告”的页面", "查找包含Python代码的页面", "查找活动宣传海报", "查找餐厅菜单或价目表照片")
    rows = _ranked(spark, sf_dir, 30).select(
        "query", text.alias("text"), F.when(n <= 1, "text_evidence").otherwise("visual_metadata").alias("route"), "item", "rank", ((F.col("item") % 20) / 10.0).alias("dense"),
        (F.col("item") % 11).cast("double").alias("lexical"), F.col("score").alias("visual"), (F.col("item") % 29 == 0).alias("quoted"),
    )
    return gates.route_guard(rows).select("query", "accepted", "signal_name", "signal")


@register(f"""
WITH {RANKED_CTE}, r AS (SELECT query, query // 50 % 3 AS n, max(score) AS best, bool_or(item % 31 = 0) AS literal FROM ranked WHERE rank BETWEEN 2 AND 11 GROUP BY query)
SELECT query, n <> 2 AND NOT literal AS applies, n <> 2 AND NOT literal AND query % 100 = 0 AND greatest(best, -1) < CASE n WHEN 0 THEN 0.35 ELSE 0.6 END AS rejects FROM r
""")
def q101_composite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for several pictured things are not answered by one: the ten vectors after each query's nearest."""
    n = F.floor(F.col("query") / 50) % 3
    text = _either(n, "猫和狗同时出现在草地照片中", "找蓝色鲸鱼游过沙漠峡谷的照片", "蓝色汽车")
    rows = _ranked(spark, sf_dir, 11).where("rank >= 2").select(
        "query", text.alias("text"), F.lit("visual_discovery").alias("route"), (F.col("query") % 100 == 0).alias("accepted"), "item", (F.col("rank") - 1).alias("rank"), F.col("score").alias("visual"),
        (F.col("item") % 31 == 0).alias("literal"),
    )
    return gates.composite_guard(rows, least=0.35, related=0.6)


@register(f"""
WITH {RANKED_CTE} SELECT query, query % 100 = 0 AND NOT bool_or(rank <= 10 AND item % 13 = 0) AS rejects FROM ranked WHERE rank <= 20 GROUP BY query
""")
def q102_context_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times relative to the asker need evidence on one of the ten nearest vectors."""
    text = F.when(F.col("query") % 100 == 0, "找我去年在海边拍的日落照片").otherwise("找蓝天下的建筑照片")
    return gates.context_guard(_ranked(spark, sf_dir, 20).select("query", text.alias("text"), "rank", (F.col("item") % 13 == 0).alias("context")))


SOURCES = {"visual_discovery": "adaptive", "visual_metadata": "adaptive", "visual_metadata_plain_object": "visual_metadata_blend", "topic_discovery_without_exact": "adaptive"}


@register(f"""
WITH r AS (SELECT item_id, {ROUTE_NAMES}[item_id % 6 + 1] AS route, item_id // 6 % 2 = 0 AS plain, item_id % 5 = 0 AS coloured, item_id % 7 = 0 AS exact, item_id % 11 = 0 AS quoted FROM items WHERE name IS NOT NULL)
SELECT item_id, CASE WHEN route = 'visual_discovery' AND coloured OR route = 'visual_metadata' AND quoted THEN 'quality_hybrid' WHEN route = 'visual_metadata' AND plain THEN 'visual_metadata_blend'
  WHEN route IN ('visual_discovery', 'visual_metadata') OR route = 'topic_discovery' AND NOT exact THEN 'adaptive' ELSE 'quality_hybrid' END AS source FROM r
""")
def q103_ranking_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ranking the route of every item's request shows."""
    i = F.col("item_id")
    query = F.concat(F.when(F.floor(i / 6) % 2 == 0, "找一张").otherwise("查找有图表的"), "name", F.lit("照片"))
    source = gates.ranking_source(query, _one_of(ROUTES, i), F.when(i % 5 == 0, "blue"), i % 7 == 0, i % 11 == 0, SOURCES)
    return _named(spark, sf_dir).select("item_id", source.alias("source"))


@register("""
WITH p AS (SELECT item_id, item_id % 4 AS n, name, brand FROM items WHERE regexp_matches(name, '^[A-Za-z ]+$') AND regexp_matches(brand, '^[A-Za-z0-9]+$')
    AND NOT regexp_matches(name, '(?i)\\b(on|above|below|behind|inside|outside|front|rear|over|under)\\b'))
SELECT item_id, CASE n WHEN 0 THEN name || ' on the right of ' || brand WHEN 1 THEN name || ' behind ' || brand WHEN 2 THEN name || '位于' || brand || '的后方' END AS opposite FROM p
""")
def q104_opposite_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of every item to its brand with the direction turned round; brands beside items have none."""
    rows = table(spark, sf_dir, "items").where(F.col("name").rlike("^[A-Za-z ]+$") & F.col("brand").rlike("^[A-Za-z0-9]+$") & ~F.col("name").rlike(r"(?i)\b(on|above|below|behind|inside|outside|front|rear|over|under)\b"))
    value = _either(
        F.col("item_id") % 4, F.concat_ws(" on the left of ", "name", "brand"), F.concat_ws(" in front of ", "name", "brand"), F.concat("name", F.lit("位于"), "brand", F.lit("的前方")), F.concat_ws(" beside ", "name", "brand")
    )
    return rows.select("item_id", gates.opposite_relation(value, True).alias("opposite"))


# ---- private texts, evidence lines, terms, answers

# The address as DuckDB must read it, whose edge of a word knows ASCII only: it starts a word of any alphabet, or with a mark behind one.
ADDRESS_SQL = r"(?i)((^|[^\p{L}\p{N}_])[A-Z0-9_]|[\p{L}\p{N}_][.%+-])[A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,}\b"


@register(f"""
WITH c AS (SELECT client_id, regexp_replace(CASE client_id % 4 WHEN 0 THEN name || ' <' || email || '>' WHEN 1 THEN 'Date of Birth of ' || name WHEN 2 THEN name || ', ID card 12' ELSE name || ' 010-1234 5678' END, '\\s+', ' ', 'g') AS t
  FROM clients WHERE name IS NOT NULL AND email IS NOT NULL)
SELECT client_id, regexp_matches(t, '{corpus.PRIVATE_WORDS}') OR regexp_matches(t, '{ADDRESS_SQL}') OR regexp_matches(t, '{corpus.LONG_NUMBER}') AS sensitive,
  CASE WHEN client_id % 4 = 2 THEN 'table_form_ticket' ELSE '' END AS category FROM c
""")
def q105_private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private data and identity papers in a text about every client."""
    name = F.col("name")
    text = _either(F.col("client_id") % 4, F.concat(name, F.lit(" <"), "email", F.lit(">")), F.concat(F.lit("Date of Birth of "), name), F.concat(name, F.lit(", ID card 12")), F.concat(name, F.lit(" 010-1234 5678")))
    rows = table(spark, sf_dir, "clients").where("name IS NOT NULL AND email IS NOT NULL")
    return rows.select("client_id", corpus.contains_sensitive(text).alias("sensitive"), corpus.suggested_category(text).alias("category"))


@register("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' of ' || p_brand WHEN 1 THEN p_name || '@example.com' WHEN 2 THEN 'telephone of ' || p_name ELSE lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS line, p_size FROM part),
  n AS (SELECT *, length(line) AS n, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\\p{Nd}]', '', 'g')) AS digits FROM p)
SELECT p_partkey, p_partkey % 4 = 0 AND p_size >= 20 AND n BETWEEN 4 AND 36 AND letters >= 0.65 * n AND digits <= 0.5 * letters AS valid FROM n
""")
def q106_evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line about every part can stand as evidence."""
    name = F.col("p_name")
    line = _either(F.col("p_partkey") % 4, F.concat(name, F.lit(" of "), "p_brand"), F.concat(name, F.lit("@example.com")), F.concat(F.lit("telephone of "), name), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", literals.valid_evidence_line(line, F.when(F.col("p_size") >= 20, 0.99).otherwise(0.5)).alias("valid"))


@register("""
SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'mixed' WHEN item_id % 4 = 1 THEN 'visual' WHEN item_id % 4 = 2 THEN 'mixed' ELSE 'visual' END AS mode FROM items WHERE regexp_matches(name, '^[A-Za-z0-9 ]+$')
""")
def q165_query_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request for every item describes a picture."""
    name, say = F.col("name"), F.lit
    query = _either(F.col("item_id") % 4, F.concat(say("森林 "), name), F.concat(say("森林和湖泊 "), name), F.concat(say("哪张图片包含森林和"), name), F.concat(say("哪张图片展示森林和"), name))
    mode = studies.query_mode(query, ("写着", "包含", "标题", "文字", "关键词", "编号"))
    return _named(spark, sf_dir).where(name.rlike("^[A-Za-z0-9 ]+$")).select("item_id", mode.alias("mode"))


@register("""
WITH r AS (SELECT item_id, list_filter(string_split(lower(name), ' '), lambda t: length(t) >= 2) AS terms, upper(split_part(name, ' ', 1)) || ' / ' || coalesce(kind, '') AS text FROM items WHERE regexp_matches(name, '^[A-Za-z]+( [A-Za-z]+)*$'))
SELECT item_id, array_to_string(terms, '|') AS terms, array_to_string(list_filter(terms, lambda t: contains(lower(text), t)), '|') AS matched FROM r WHERE len(list_distinct(terms)) = len(terms)
""")
def q170_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a question for every item of different words, and those that a text about it holds."""
    words = F.split(F.lower("name"), " ")
    rows = _named(spark, sf_dir).where(F.col("name").rlike("^[A-Za-z]+( [A-Za-z]+)*$") & (F.size(F.array_distinct(words)) == F.size(words)))
    query = F.concat(F.lit("哪张图片展示了"), "name")
    text = F.concat(F.upper(F.get(F.split("name", " "), F.lit(0))), F.lit(" / "), F.coalesce("kind", F.lit("")))
    return rows.select("item_id", F.array_join(explain.query_terms(query), "|").alias("terms"), F.array_join(explain.matched_terms(query, text), "|").alias("matched"))


@register(f"WITH n AS (SELECT event_id, {BITS} FROM events) SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN {NEED_SQL} END AS route FROM n")
def q172_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a model's answer for every event under its contract; two in five answers break it."""
    held = [(F.shiftright("event_id", NEEDS.index(f)).bitwiseAND(F.lit(1)) == 1 if f in NEEDS else F.lit(False)).alias(f) for f in explain.INTENT_FIELDS]
    payload = F.when(F.col("event_id") % 5 == 3, F.to_json(F.struct(*held, F.lit(True).alias("extra")))).when(F.col("event_id") % 5 == 4, F.concat(F.lit("这里是解释文字 "), "event_type")).otherwise(F.to_json(F.struct(*held)))
    rows = table(spark, sf_dir, "events").select("event_id", explain.intent_fields(payload).alias("e"))
    return rows.select("event_id", F.when(F.col("e").isNotNull(), intent.evidence_route({f: F.col(f"e.{f}") for f in explain.INTENT_FIELDS})).alias("route"))
