"""Rules over queries, reviews and pages, held against stated cases: a case table goes through the operator."""

import json
from itertools import product

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import conditions, corpus, evidence, explain, gates, intent, literals, studies

CASES = {}


def stated(columns, rows):
    """Adds a function of the session that must give ``rows``."""

    def add(made):
        CASES[made.__name__] = (made, columns.split(", "), list(rows))
        return made

    return add


BOTH = ("哪份资料必须包含“Alpha Project”，并同时包含“Budget 2026”？", "帮我找同时写有“Alpha Project”和“Budget 2026”的那一页。", "同页出现「Alpha Project」和「Budget 2026」。", "同时核验【Alpha Project】以及【Budget 2026】。")

FAX = "找出发件机构为 Covington & Burling、日期为1999年12月9日的传真页。"

# Queries, level, and the labels found with their sources.
CONDITIONS = (
    (FAX, "basic", "1999年12月9日|Covington & Burling", "structured_date|latin_phrase"),
    ("要求用蓝色墨水和大写字母填写、必填项带星号", "basic", "蓝色墨水|大写字母|必填项", "translation_alias|translation_alias|translation_alias"),
    ("查找卫念念的登记表，联系电话末位为9", "basic", "卫念念|phone_number_ends_with_9", "chinese_name|phone_suffix"),
    ("哪一页记录了患者赵海鹏？", "basic", "赵海鹏", "chinese_name"),
    ("哪些页面出现了实体“汇丰晋信”？", "basic", "汇丰晋信", "chinese_entity"),
    *((q, "explicit", "Alpha Project|Budget 2026", "explicit_required|explicit_required") for q in BOTH),
    ("有哪些文档讨论 KOOL Naturals 的宣传方案？", "explicit", "KOOL Naturals", "latin_phrase"),
    ("有哪些文档同时含有表格和图片？", "explicit", "", ""),
)


@stated("query, level, labels, sources", CONDITIONS)
def literal_conditions(spark) -> DataFrame:
    """Conditions of stated queries at each level, in order."""
    rows = spark.createDataFrame([r[:2] for r in CONDITIONS], "query string, level string")
    found = [rows.where(F.col("level") == level).withColumn("c", conditions.literal_conditions(F.col("query"), level)) for level in conditions.LEVELS]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    joined = lambda field: F.array_join(F.transform("c", lambda x: x[field]), "|")
    return every.select("query", "level", joined("label").alias("labels"), joined("source").alias("sources"))


# Query, level, lines of a page, conditions and how many the page meets.
PAGES = (
    (FAX, "basic", "COVINGTO N& B URLING|Date: December 9, 1999", 2, 2, True),
    ("找出发件机构为 Covington & Burling、日期为1999年12月8日的传真页。", "basic", "COVINGTON & BURLING|Date: December 9, 1999", 2, 1, False),
    ("要求用蓝色墨水和大写字母填写、必填项带星号", "basic", "Please use black ink and BLOCK CAPITALS. All fields are mandatory.", 3, 2, False),
    ("查找卫念念的登记表，联系电话末位为9", "basic", "姓名 卫念念|联系电话 15918555738|出生日期 1999", 2, 1, False),
    ("查找卫念念的登记表，联系电话末位为9", "basic", "姓名 卫念念|联系电话 15918555739", 2, 2, True),
    (BOTH[0], "explicit", "Alpha Project", 2, 1, False),
    (BOTH[0], "explicit", "Alpha Project|Budget 2026", 2, 2, True),
    ("哪份资料必须包含“DIRECT ACCOUNTS”，并同时包含“OUTSIDE REGION”？", "explicit", "DIRECT ACCOUNT|OUTSIDE REGIONS", 2, 1, False),
    ("日期为1999年12月9日的传真", "structured", "12/9/99", 1, 1, True),
    ("日期为1999年12月9日的传真", "structured", "Dec. 9th, 1999", 1, 1, True),
    ("日期为1999年12月9日的传真", "structured", "1999-12-08", 1, 0, False),
    ("编号为AB-12的记录", "structured", "see AB-12 here", 2, 2, True),
    ("有哪些文档讨论 KOOL Naturals 的宣传方案？", "explicit", "KOOL|the natu-|rals Naturals plan", 1, 1, True),
)


@stated("query, level, lines, n_conditions, n_matched, complete", PAGES)
def literal_evidence(spark) -> DataFrame:
    """How many conditions of a query a page meets."""
    rows = spark.createDataFrame([r[:3] for r in PAGES], "query string, level string, lines string")
    out = None
    for level in conditions.LEVELS:
        part = rows.where(F.col("level") == level).withColumn("c", conditions.literal_conditions(F.col("query"), level))
        part = evidence.with_evidence(part.withColumn("page", F.split("lines", r"\|")), conditions="c", lines="page", level=level, out="e")
        out = part if out is None else out.unionByName(part)
    return out.select("query", "level", "lines", "e.n_conditions", "e.n_matched", "e.complete")


# Query, level, whether literal evidence may override, why, and kinds that are mentioned but not found.
ELIGIBLE = (
    ("有哪些文档讨论 KOOL Naturals 的宣传方案？", "explicit", True, "explicit_named_discovery_contract_v19_2", ""),
    ("有哪些文档同时含有表格和图片？", "explicit", False, "no_high_precision_literal_contract", ""),
    ("哪份资料必须包含“Original invoice number”，并同时包含“Virginia 23219”？", "explicit", True, "high_precision_structured_contract", ""),
    *((q, "explicit", True, "high_precision_structured_contract", "") for q in BOTH),
    (FAX, "structured", True, "high_precision_structured_contract", ""),
    ("哪一页记录了患者赵海鹏？", "structured", True, "exact_entity_contract", ""),
    ("KOOL Naturals", "explicit", False, "no_high_precision_literal_contract", ""),
    ("哪一页有编号？", "structured", False, "necessary_condition_extraction_incomplete", "structured_identifier"),
)


@stated("query, level, eligible, reason, missing", ELIGIBLE)
def override_eligibility(spark) -> DataFrame:
    """Whether literal evidence may override the ranking of stated queries."""
    rows = spark.createDataFrame([r[:2] for r in ELIGIBLE], "query string, level string")
    read = lambda level: rows.where(F.col("level") == level).withColumn("conditions", conditions.literal_conditions(F.col("query"), level))
    parts = [conditions.override_eligibility(read(level), "query", level, out="e") for level in conditions.LEVELS[1:]]
    return parts[0].unionByName(parts[1]).select("query", "level", "e.eligible", "e.reason", F.array_join("e.missing", "|").alias("missing"))


# Case, query, candidates in order with their lines.
CANDIDATES = (
    ("a", BOTH[0], "partial", 1, "Alpha Project"), ("a", BOTH[0], "complete", 2, "Alpha Project|Budget 2026"), ("a", BOTH[0], "later", 3, "Budget 2026|Alpha Project"),
    ("b", "哪份资料必须包含“DIRECT ACCOUNTS”，并同时包含“OUTSIDE REGION”？", "near", 1, "DIRECT ACCOUNT|OUTSIDE REGIONS"),
    ("b", "哪份资料必须包含“DIRECT ACCOUNTS”，并同时包含“OUTSIDE REGION”？", "exact", 2, "DIRECT ACCOUNTS|OUTSIDE REGION"),
    ("c", "有哪些文档同时含有表格和图片？", "any", 1, "表格"), ("d", BOTH[1], "half", 1, "Budget 2026"),
)

SELECTED = (("a", "complete", 2, True), ("b", "exact", 2, True), ("c", None, None, False), ("d", None, None, False))


@stated("query_id, item, rank, accepted", SELECTED)
def literal_selection(spark) -> DataFrame:
    """The first candidate that meets every condition, for eligible queries."""
    rows = spark.createDataFrame(CANDIDATES, "query_id string, query string, item string, rank int, lines string").withColumn("lines", F.split("lines", r"\|"))
    return evidence.select_literal(rows, level="explicit", fuzzy=0.84)


# Queries and their routes.
ROUTES = {
    "visual_discovery": "山水 森林 蓝天白云 海边日落 湖泊倒影 草原 瀑布 美丽 蓝 蓝色汽车 天地 沙漠 城市夜景 跑车 田野 找一张红色跑车照片 山林 山峰 山水画",
    "entity_exact": "方岩松 盛和 张三 李白 欧阳娜娜 姓名是方岩松 找一个名为方岩松的人 查找方岩松的资料",
    "topic_discovery": "方程式 林业 马达 高等数学 量子力学 深度学习 神经网络 王者荣耀 高速公路 自然语言处理 建筑学 动物学 车辆工程 蓝牙 白血病 找一下介绍深度学习方法的那一页",
    "text_evidence": "哪份文档包含课程成绩 哪张图片上写着北京理工大学 地址是哪里 编号20210001在哪份文件 哪份文档包含课程成绩？ 哪张场景照片中出现“惠图仿石艺术漆”和“品质浇筑美好”？",
    "visual_metadata": "哪张图片是身份证正面 找带印章的正式文件 查找有柱状图的汇报幻灯片 找有三栏排版的幻灯片 找带搜索框的手机界面 找包含错误提示弹窗的截图 找包含流程图的PPT页面 查找一张展示“AParkCorner”的自然图像。",
    "mixed": "如何设计一个检索系统 谁获得了一等奖 如何设计一个检索系统？ 找包含英文广告牌的街景照片 查找会议室白板上写着明天计划的照片 找车库里蓝色自行车的维修记录",
}

ROUTED = tuple((q, r) for r, qs in ROUTES.items() for q in qs.split())


@stated("query, route", ROUTED)
def route_regression(spark) -> DataFrame:
    """Routes of the regression queries."""
    return spark.createDataFrame([(q,) for q, _ in ROUTED], "query string").select("query", intent.route(F.col("query")).alias("route"))


# Query, strict entity, colour, pure colour, topic phrases, relative times.
PARSED = (
    ("方岩松", "方岩松", None, False, "方岩松", ""), ("查找方岩松的资料", "方岩松", None, False, "方岩松", ""), ("量子力学", None, None, False, "量子力学", ""),
    ("盛和", "盛和", None, False, "", ""), ("方程式", None, None, False, "方程式", ""), ("蓝", None, "blue", True, "", ""), ("找蓝色汽车", None, "blue", False, "蓝色汽车", ""),
    ("找一张蓝色图片", None, "blue", True, "蓝色", ""), ("蓝牙", None, None, False, "蓝牙", ""), ("白血病", None, None, False, "白血病", ""),
    ("查找标题里有年度报告的文档", None, None, False, "年度报告", ""), ("找带参考文献列表的学术资料", None, None, False, "参考文献列表|参考文献", ""),
    ("找昨晚收到的通知截图", None, None, False, "昨晚收到|通知", "昨晚"), ("找蓝天下的建筑照片", None, None, False, "蓝天下|建筑", ""),
)


@stated("query, entity, colour, pure_colour, topics, times", PARSED)
def query_terms(spark) -> DataFrame:
    """Names, colours, topics and relative times in queries."""
    q = F.col("query")
    return spark.createDataFrame([(r[0],) for r in PARSED], "query string").select(
        "query", intent.strict_entity(q).alias("entity"), intent.colour_intent(q).alias("colour"), intent.is_pure_colour(q).alias("pure_colour"),
        F.array_join(intent.topic_terms(q), "|").alias("topics"), F.array_join(intent.temporal_terms(q), "|").alias("times"),
    )


# Query, route, exploratory, entity, what its expansion holds.
INTENTS = (
    ("蓝", "visual_discovery", True, None, "以蓝色为主要色调"), ("蓝色汽车", "visual_discovery", True, None, "蓝色汽车，主体内容必须匹配"), ("天地", "visual_discovery", True, None, "天空与大地"),
    ("美丽", "visual_discovery", True, None, "自然风景"), ("森林", "visual_discovery", True, None, "绿色森林"), ("跑车", "visual_discovery", True, None, "跑车，与该主题直接相关"),
    ("方岩松", "entity_exact", False, "方岩松", "方岩松"), ("量子力学", "topic_discovery", True, None, "量子力学"), ("谁获得了一等奖", "mixed", False, None, "谁获得了一等奖"),
)


@stated("query, route, exploratory, entity, holds", ((*r[:4], True) for r in INTENTS))
def search_intents(spark) -> DataFrame:
    """Route, mode, entity and search text of queries."""
    rows = spark.createDataFrame([(r[0], r[4]) for r in INTENTS], "query string, want string").withColumn("i", intent.search_intent(F.col("query")))
    return rows.select("query", "i.route", "i.exploratory", "i.entity", F.contains("i.search_query", F.col("want")).alias("holds"))


# Method, route, exploratory, and the branches text, bm25, visual.
BRANCHES = (
    ("text", "mixed", False, True, False, False), ("visual", "mixed", False, False, False, True), ("quality_hybrid", "visual_discovery", True, True, True, True),
    ("reranker", "visual_discovery", True, True, True, True), ("quality_hybrid", "topic_discovery", True, True, True, False), ("reranker", "text_evidence", False, True, True, False),
    ("quality_hybrid", "text_evidence", False, True, True, False), ("quality_hybrid", "mixed", False, True, True, True), ("reranker", "visual_metadata", False, True, False, True),
    ("reranker", "entity_exact", False, True, True, False), ("reranker", "mixed", False, True, True, True),
)


@stated("method, route, exploratory, text, bm25, visual", BRANCHES)
def search_branches(spark) -> DataFrame:
    """Branches a search needs, by method and route."""
    rows = spark.createDataFrame([r[:3] for r in BRANCHES], "method string, route string, exploratory boolean")
    return rows.select("*", intent.branches(F.col("method"), F.col("route"), F.col("exploratory")).alias("b")).select("method", "route", "exploratory", "b.*")


NEEDS = ("needs_literal_text", "needs_visual_semantics", "needs_layout_structure", "needs_exact_entity", "needs_topic_discovery")


def _needed(literal, visual, layout, entity, topic):
    if entity:
        return "entity_exact"
    if literal and (visual or layout):
        return "mixed"
    return "visual_metadata" if layout else "visual_discovery" if visual else "topic_discovery" if topic else "text_evidence" if literal else "mixed"


@stated(", ".join((*NEEDS, "route")), ((*x, _needed(*x)) for x in product((True, False), repeat=5)))
def evidence_routes(spark) -> DataFrame:
    """The route of every combination of needs."""
    rows = spark.createDataFrame(list(product((True, False), repeat=5)), ", ".join(f"{n} boolean" for n in NEEDS))
    return rows.withColumn("route", intent.evidence_route({n: F.col(n) for n in NEEDS}))


# Query, rule's route, ambiguous, model's route (none: it failed), route taken, source, reason.
HYBRID = (
    ("哪页写着会议通知？", "text_evidence", False, None, "text_evidence", "rule", None), ("帮我找一下像公园夜景的那页", "mixed", True, "visual_discovery", "visual_discovery", "llm", None),
    ("一条歧义查询", "mixed", True, None, "mixed", "rule_fallback", None),
    ("白色列车在铁路桥上行驶", "visual_discovery", True, "text_evidence", "visual_discovery", "rule_guard", "preserve_visual_route_without_literal_requirement"),
    ("一张小票，文字总额为174600", "mixed", True, "text_evidence", "text_evidence", "llm", None),
    ("银色电脑屏幕显示森林，右侧放着光盘", "visual_discovery", True, "mixed", "visual_discovery", "rule_guard", "preserve_visual_route_without_literal_requirement"),
    ("一张员工年休假申请表，申请人为桑新平，户籍所在地为四川省绵阳市", "mixed", True, "entity_exact", "mixed", "rule_guard", "reject_entity_route_for_long_compound_query"),
)


@stated("query, rule, ambiguous, model, route, source, reason", HYBRID)
def hybrid_routes(spark) -> DataFrame:
    """Rule and model routes brought together under the guards."""
    rows = spark.createDataFrame([r[:4] for r in HYBRID], "query string, rule string, ambiguous boolean, model string")
    out = rows.withColumn("h", intent.hybrid_route(F.col("query"), F.col("rule"), F.col("ambiguous"), F.col("model")))
    return out.select("query", "rule", "ambiguous", "model", "h.*")


# Query, whether the rules' route leaves doubt and why.
DOUBTS = (
    ("找一张蓝色海边照片", ""), ("材料里有没有林雨琪？", "rule_route_mixed|probable_person_lookup_missed_by_rule"), ("整理一下与储能安全相关的材料", ""),
    ("哪份申请表右下角盖了红色印章？", "explicit_compound_evidence_missed_by_rule"), ("我记得山景照片里的路牌写着海拔三千米。", ""), ("标题写着“设备采购清单”的页面在哪里？", ""),
    ("找蓝色瓶子且标签写着丙酮的照片。", "explicit_compound_evidence_missed_by_rule"),
)

RECOVERED = (("材料里有没有梁思远？", "entity_exact"), ("材料中有没有ZX-410？", "entity_exact"), ("我记得一张图中厨师正把锅抛起，旁边有火苗。", "visual_discovery"), ("森林", "visual_discovery"))


@stated("query, reasons", DOUBTS)
def route_ambiguity(spark) -> DataFrame:
    """Why a model is asked about a route."""
    q = F.col("query")
    return spark.createDataFrame([(r[0],) for r in DOUBTS], "query string").select("query", F.array_join(intent.ambiguity(q, intent.route(q)), "|").alias("reasons"))


@stated("query, route", RECOVERED)
def recovered_routes(spark) -> DataFrame:
    """Persons, codes and plain scenes the first rules miss."""
    return spark.createDataFrame([(r[0],) for r in RECOVERED], "query string").select("query", intent.calibrated_route(F.col("query")).alias("route"))


# Query, old route, new route, compositional, route applied, reason.
TRANSITIONS = (
    ("找出明确写有金额的页面", "mixed", "visual_discovery", None, "mixed", "preserve_factual_acceptance"),
    ("帮我找一个可能的人名", "text_evidence", "entity_exact", None, "text_evidence", "entity_exact_without_strict_term"),
    ("金额和红色印章必须同时满足", "mixed", "text_evidence", True, "mixed", "compositional_candidate_removes_legacy_branch"),
    ("找一份材料", "mixed", "text_evidence", False, "mixed", "candidate_removes_legacy_branch"),
    ("找右上角带校徽的封面", "mixed", "visual_metadata", False, "visual_metadata", None),
)


@stated("query, old, new, compositional, route, reason", TRANSITIONS)
def transition_guard(spark) -> DataFrame:
    """New routes that would weaken what the old route secures are turned down."""
    rows = spark.createDataFrame([r[:4] for r in TRANSITIONS], "query string, old string, new string, compositional boolean")
    guard = intent.transition_guard(F.lit("quality_hybrid"), F.col("old"), F.col("new"), F.col("compositional"), intent.strict_entity(F.col("query")))
    return rows.withColumn("g", guard).select("query", "old", "new", "compositional", "g.*")


# Query, route, candidates (dense, lexical, visual, quoted), accepted, signal.
GUARDED = (
    ("查找包含Python代码的页面", "text_evidence", ((0.45, 28.0, 0.0, False), (0.55, 2.0, 0.0, False)), False, 0), ("查找标题里有年度报告的文档", "text_evidence", ((0.55, 8.0, 0.0, False),), True, 1),
    ("查找活动宣传海报", "visual_metadata", ((0.60, 12.0, 0.20, False),), False, 0), ("查找餐厅菜单或价目表照片", "visual_metadata", ((0.51, 0.0, 0.48, False),), False, 0),
    ("查找“年度报告”的页面", "text_evidence", ((0.9, 9.0, 0.9, False),), False, 0), ("查找“年度报告”的页面", "mixed", ((0.1, 0.0, 0.0, True),), None, None),
    ("随便", "visual_metadata", (), False, 0), ("森林", "visual_discovery", ((0.1, 0.0, 0.9, False),), None, None),
)


@stated("query, accepted, signal", ((i, ok, n) for i, (_, _, _, ok, n) in enumerate(GUARDED)))
def route_guard(spark) -> DataFrame:
    """Evidence of a route must meet on one candidate."""
    rows = [(i, q, r, f"c{k}" if c else None, k, *(c or (None,) * 4)) for i, (q, r, cs, *_) in enumerate(GUARDED) for k, c in enumerate(cs or (None,), 1)]
    made = spark.createDataFrame(rows, "query int, text string, route string, item string, rank int, dense double, lexical double, visual double, quoted boolean")
    return gates.route_guard(made).select("query", "accepted", "signal")


# Query, route, best visual score, complete literal page, floor, floor of relations, composite, rejected.
COMPOSED = (
    ("钢琴旁摆放手写乐谱和小提琴的室内照片", "visual_metadata", 0.341, False, 0.35, None, True, True), ("猫和狗同时出现在草地照片中", "visual_metadata", 0.41, False, 0.35, None, True, False),
    ("哪张场景照片中出现“JINGMI Rd”和“自行车优先”？", "visual_metadata", 0.30, True, 0.40, None, False, False), ("查找宠物戴红色帽子的照片", "visual_discovery", 0.35, False, 0.40, None, True, True),
    ("找蓝色鲸鱼游过沙漠峡谷的照片", "visual_discovery", 0.451, False, 0.40, 0.46, True, True), ("蓝色汽车", "visual_discovery", 0.1, False, 0.40, None, False, False),
    ("文档包含日期和很多其他内容", "text_evidence", 0.1, False, 0.40, None, False, False),
)


@stated("query, applies, rejects", ((r[0], r[6], r[7]) for r in COMPOSED))
def composite_guard(spark) -> DataFrame:
    """Requests for several pictured things are not answered by one."""
    out = None
    for q, r, visual, literal, least, related, *_ in COMPOSED:
        rows = spark.createDataFrame([(q, q, r, True, "a", 1, visual, literal)], "query string, text string, route string, accepted boolean, item string, rank int, visual double, literal boolean")
        part = gates.composite_guard(rows, least=least, related=related)
        out = part if out is None else out.unionByName(part)
    return out


# Query, whether a page of the first ten has evidence of its time, rejected.
TIMED = (("找我去年在海边拍的日落照片", False, True), ("找我去年在海边拍的日落照片！", True, False), ("找蓝天下的建筑照片", False, False))


@stated("query, rejects", ((r[0], r[2]) for r in TIMED))
def context_guard(spark) -> DataFrame:
    """Times relative to the asker need evidence."""
    rows = spark.createDataFrame([(q, q, 1, held) for q, held, _ in TIMED], "query string, text string, rank int, context boolean")
    return gates.context_guard(rows)


# Query, route, colour, exact topic, quoted, ranking shown.
SOURCES = {"visual_discovery": "adaptive", "visual_metadata": "adaptive", "visual_metadata_plain_object": "visual_metadata_blend", "topic_discovery_without_exact": "adaptive"}

SHOWN = (
    ("蓝", "visual_discovery", "blue", False, False, "quality_hybrid"), ("查找有公式和图表的论文", "visual_metadata", None, False, False, "adaptive"),
    ("找一张手机照片", "visual_metadata", None, False, False, "visual_metadata_blend"), ("量子力学", "topic_discovery", None, False, False, "adaptive"),
    ("量子力学", "topic_discovery", None, True, False, "quality_hybrid"), ("“年度报告”", "visual_metadata", None, False, True, "quality_hybrid"), ("谁", "mixed", None, False, False, "quality_hybrid"),
)


@stated("query, route, colour, exact, quoted, source", SHOWN)
def ranking_sources(spark) -> DataFrame:
    """Which ranking a route shows."""
    rows = spark.createDataFrame([r[:5] for r in SHOWN], "query string, route string, colour string, exact boolean, quoted boolean")
    return rows.withColumn("source", gates.ranking_source(F.col("query"), F.col("route"), F.col("colour"), F.col("exact"), F.col("quoted"), SOURCES))


# Relations and their opposites.
TURNED = (
    ("农田位于山脉的前方", True, "农田位于山脉的后方"), ("列车在水面上方", True, "列车在水面下方"), ("cat on the left of dog", False, "cat on the right of dog"),
    ("text on the back of a car", False, "text on the front of a car"), ("zone in front of the hitter", True, "zone behind the hitter"), ("cat beside dog", True, None), ("person", False, None),
)


@stated("value, newer, opposite", TURNED)
def opposite_relations(spark) -> DataFrame:
    """Relations with their direction turned round."""
    rows = spark.createDataFrame([r[:2] for r in TURNED], "value string, newer boolean")
    opposite = F.when(F.col("newer"), gates.opposite_relation(F.col("value"), True)).otherwise(gates.opposite_relation(F.col("value")))
    return rows.withColumn("opposite", opposite)


# Texts, whether they name private data, category they suggest; lines, whether they are evidence.
PRIVATE = (
    ("Email: user@example.com", True, ""), ("身份证 210123199901011234", True, "table_form_ticket"), ("普通课程通知", False, ""), ("call 010-1234 5678", True, ""),
    ("姓名 朋朋 性别 男 出生 1996年 公民身份号码", True, "table_form_ticket"), ("姓名 李明 性别 男", True, ""), ("论文实验结果", False, ""), ("Date of Birth", True, ""), ("an ID card", False, "table_form_ticket"),
)

LINES = (
    ("1234567890", False), ("tingting@example.com", False), ("家庭住址：某省某市", False), ("1201 Pennsylvania Avenue, N.W.", False), ("www.example.com", False), ("question", False),
    ("卷积神经网络", True), ("Annual report of the board", True), ("独特实验设置", True), ("abc", False),
)


@stated("text, sensitive, category", PRIVATE)
def private_texts(spark) -> DataFrame:
    """Private data and identity papers in stated texts."""
    rows = spark.createDataFrame([r[:1] for r in PRIVATE], "text string")
    return rows.select("text", corpus.contains_sensitive(F.col("text")).alias("sensitive"), corpus.suggested_category(F.col("text")).alias("category"))


@stated("line, valid", LINES)
def evidence_lines(spark) -> DataFrame:
    """Stated lines that can, or cannot, stand as evidence."""
    rows = spark.createDataFrame([r[:1] for r in LINES], "line string")
    return rows.select("line", literals.valid_evidence_line(F.col("line"), F.lit(0.99)).alias("valid"))


# Reviews and what is wrong with them; known ids are a and b.
REVIEWS = (
    ("accepted", "who", "a;b", None), ("revised", " ", "a", "blank_query"), ("accepted", "who", "", "missing_relevant_ids"), ("no_answer", "who", "a", "relevant_ids_without_answer"),
    ("no_answer", "who", "", None), ("excluded", "", "", None), ("accepted", "who", "a,c", "unknown_ids"), ("maybe", "who", "a", "unsupported_decision"),
)


@stated("decision, query, ids, fault", REVIEWS)
def review_faults(spark) -> DataFrame:
    """Faults of stated query reviews."""
    rows = spark.createDataFrame([r[:3] for r in REVIEWS], "decision string, query string, ids string")
    return rows.withColumn("fault", studies.review_fault(F.col("decision"), F.col("query"), F.col("ids"), F.array(F.lit("a"), F.lit("b"))))


# Quality reviews and what is wrong with them.
QUALITY = (
    (True, "accepted", "", "blur", None), (False, "accepted", "", "", "unknown_item"), (True, "keep", "", "", "unsupported_decision"), (True, "reclassified", "", "", "missing_category"),
    (True, "reclassified", "form", "", None), (True, "accepted", "none", "", "unsupported_category"), (True, "ocr_retry", "", "blur;odd", "unsupported_tags"),
)


@stated("known, decision, category, tags, fault", QUALITY)
def quality_review_faults(spark) -> DataFrame:
    """Faults of stated quality reviews."""
    rows = spark.createDataFrame([r[:4] for r in QUALITY], "known boolean, decision string, category string, tags string")
    return rows.withColumn("fault", studies.quality_review_fault(F.col("known"), F.col("decision"), F.col("category"), F.col("tags"), ("form", "photo"), ("blur", "skew")))


# Query, flags, ranks of the branches, priority and reasons.
PRIORITIES = (
    ("", "", None, None, None, 100.0, "blank_query"), ("q", "privacy_query_requires_manual,evidence_not_unique", 1, 9, 1, 90.0, "privacy|nonunique_evidence"),
    ("q", "", 4, 5, 3, 34.0, "both_branches_fail|adaptive_not_top1"), ("q", "category_needs_confirmation", None, 8, 50, 48.0, "category|adaptive_not_top1"), ("q", "", 1, 1, 1, 0.0, ""),
)


@stated("query, flags, t, v, a, score, reasons", PRIORITIES)
def review_priorities(spark) -> DataFrame:
    """Priority of stated queries and why."""
    rows = spark.createDataFrame([r[:5] for r in PRIORITIES], "query string, flags string, t int, v int, a int")
    rows = rows.withColumn("p", studies.review_priority(F.col("query"), F.col("flags"), F.col("t"), F.col("v"), F.col("a")))
    return rows.select("query", "flags", "t", "v", "a", "p.score", F.array_join("p.reasons", "|").alias("reasons"))


# Lines of pages with confidence and document frequency, and the evidence chosen.
EVIDENCE = (("p", "常见标题内容", 0.99, 5), ("p", "独特实验设置", 0.90, 1), ("p", "独特实验", 0.99, 1), ("q", "only line", 0.7, 1))


@stated("item, evidence", (("p", "独特实验设置|常见标题内容"), ("q", "only line")))
def chosen_evidence(spark) -> DataFrame:
    """Evidence lines of stated pages: rare and long first, none inside another."""
    rows = spark.createDataFrame(EVIDENCE, "item string, text string, confidence double, df int")
    return studies.chosen_evidence(rows).select("item", F.array_join("evidence", "|").alias("evidence"))


# Reviews of a model and whether they stand; pool decisions and records of "no answer", and their faults.
MODEL = (("yes", 0.95, None, True), ("yes", 0.85, None, False), ("yes", 0.95, "a", False), ("unsure", 0.99, None, False))

POOLS = (("relevant_candidate_in_pool", True, None), ("relevant_candidate_in_pool", False, "no_relevant_candidate"), ("no_relevant_candidate_in_pool", True, "marked_relevant"), ("other", False, "unknown_decision"))

ABSENT = (
    ("a" * 64, 1, 5, 2, True, False, None), ("xyz", 1, 5, 2, True, False, "pool_sha256"), ("a" * 64, 0, 5, 2, True, False, "retrieval_runs"), ("a" * 64, 1, 0, 2, True, False, "candidate_count"),
    ("a" * 64, 1, 5, 1, True, False, "reviewer_count"), ("a" * 64, 1, 5, 2, False, False, "adjudicated"), ("a" * 64, 1, 5, 2, True, None, "known_relevant_outside_pool"),
)


@stated("kind, n, said", ((f"{kind}{i}", i, r) for kind, rs in (("model", [str(r[3]).lower() for r in MODEL]), ("pool", [r[2] for r in POOLS]), ("absent", [r[6] for r in ABSENT])) for i, r in enumerate(rs)))
def judgment_rules(spark) -> DataFrame:
    """Stated model reviews, pool decisions and no-answer records under their rules."""
    name = lambda kind: (F.concat(F.lit(kind), F.col("n").cast("string")).alias("kind"), "n")
    model = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(MODEL)], "n int, decision string, confidence double, u string")
    model = studies.sure_reviews(model.withColumn("uncertain_item_ids", F.when(F.col("u").isNotNull(), F.array("u"))), ("yes", "no"))
    pools = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(POOLS)], "n int, decision string, relevant boolean")
    absent = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(ABSENT)], "n int, pool_sha256 string, runs int, candidate_count int, reviewer_count int, adjudicated boolean, known_relevant_outside_pool boolean")
    absent = absent.withColumn("retrieval_runs", F.array_repeat(F.lit("r"), F.col("runs")))
    out = model.select(*name("model"), F.col("auto").cast("string").alias("said"))
    out = out.unionByName(pools.select(*name("pool"), studies.pool_judgment_fault(F.col("decision"), F.col("relevant")).alias("said")))
    return out.unionByName(absent.select(*name("absent"), studies.no_answer_fault({c: F.col(c) for c in absent.columns}).alias("said")))


# Route, colour, best scores of colour, looks and text, exact pages, accepted.
DISCOVERED = (
    ("visual_discovery", "blue", 0.2, 0.0, 0.0, 0, True), ("visual_discovery", "blue", 0.1, 0.9, 0.9, 0, False), ("visual_discovery", None, 0.9, 0.36, 0.0, 0, True),
    ("visual_discovery", None, 0.9, 0.34, 0.9, 5, False), ("topic_discovery", None, 0.0, 0.0, 0.44, 0, True), ("topic_discovery", None, 0.0, 0.9, 0.43, 0, False), ("topic_discovery", None, 0.0, 0.0, 0.1, 1, True),
)


@stated("route, colour, c, v, t, exact, accepted", DISCOVERED)
def discovery_accepted(spark) -> DataFrame:
    """Whether stated browsing queries find anything."""
    rows = spark.createDataFrame([r[:6] for r in DISCOVERED], "route string, colour string, c double, v double, t double, exact int")
    best = {"colour": F.col("c"), "visual": F.col("v"), "text": F.col("t")}
    return rows.withColumn("accepted", gates.discovery_accepted(F.col("route"), F.col("colour"), best, F.col("exact")))


# Phrases of pages with document frequency and whether a neighbour has them, and those chosen.
PHRASES = (("a", "alpha beta gamma", 1, False), ("a", "beta gamma", 1, False), ("a", "delta", 1, False), ("a", "common words", 3, False), ("a", "shared phrase here", 1, True), ("b", "one", 2, False))


@stated("item, phrases", (("a", "alpha beta gamma|delta"), ("b", "one")))
def distinctive_phrases(spark) -> DataFrame:
    """Rare phrases of stated pages that a neighbour lacks."""
    rows = spark.createDataFrame(PHRASES, "item string, phrase string, df int, on_neighbour boolean")
    return studies.distinctive_phrases(rows).select("item", F.array_join("phrases", "|").alias("phrases"))


# Tag lists and their normal form.
TAGS = (("clear;blurry", "blur"), ("clear_scan", "clear"), ("glare, reflection;odd", "reflection"), ("perspective;tilt;shadow", "tilt;shadow"), ("", ""))


@stated("tags, normal", TAGS)
def quality_tags(spark) -> DataFrame:
    """Stated tag lists in normal form."""
    return spark.createDataFrame([r[:1] for r in TAGS], "tags string").select("tags", studies.quality_tags(F.col("tags")).alias("normal"))


# Questions and their near negatives.
NEAR = (
    ("What is on the red sign?", "What is on the blue sign?", "color_substitution"), ("Is the cat under the table?", "Is the cat on top of the table?", "relation_substitution"), ("Who wrote this?", None, None),
)


@stated("question, query, kind", NEAR)
def near_negatives(spark) -> DataFrame:
    """Stated questions with one condition changed, read from their tags."""
    rows = spark.createDataFrame([(["x", f"question= {q} "],) for q, *_ in NEAR], "tags array<string>").select(studies.tagged_question(F.col("tags")).alias("question"))
    near = studies.near_negative(F.col("question"), {"red": "blue", "green": "yellow"}, (("under", "on top of"), ("left", "right")))
    return rows.withColumn("n", near).select("question", "n.query", "n.kind")


@stated("a, b, c", ((a, b, c) for a, b in ((0.1, 1.0), (0.2, 2.0)) for c in (5.0, 6.0, 7.0)))
def configurations(spark) -> DataFrame:
    """A grid in which two fields move together."""
    return studies.configurations(spark, {"a": [0.1, 0.2], "b": [1, 2], "c": [5, 6, 7]}, paired=[("a", "b")])


# Queries and their mode.
MODES = (("哪张图片展示了海边日落和水面倒影？", "visual"), ("哪张图片包含北京理工大学成绩单和课程分数？", "mixed"), ("哪张图片展示蓝天湖泊和建筑？", "visual"), ("森林", "mixed"), ("森林和湖泊", "visual"))


@stated("query, mode", MODES)
def query_modes(spark) -> DataFrame:
    """Whether stated queries describe a picture."""
    rows = spark.createDataFrame([r[:1] for r in MODES], "query string")
    return rows.select("query", studies.query_mode(F.col("query"), ("写着", "包含", "标题", "文字", "关键词", "编号")).alias("mode"))


# Queries, texts, terms, matched terms and the branch that decides.
TERMS = (
    ("哪张图片展示了海边日落", "海边 SUNSET 日落", "海边日落|海边|边日|日落", "海边|日落"), ("find AB-12 in Report", "the report ab-12", "find|ab-12|in|report", "ab-12|report"), ("这张的", "x", "", ""),
)


@stated("query, text, terms, matched", TERMS)
def matched_terms(spark) -> DataFrame:
    """Terms of stated queries and those their texts hold."""
    rows = spark.createDataFrame([r[:2] for r in TERMS], "query string, text string")
    return rows.select(
        "query", "text", F.array_join(explain.query_terms(F.col("query")), "|").alias("terms"), F.array_join(explain.matched_terms(F.col("query"), F.col("text")), "|").alias("matched")
    )


def _payload(**changed) -> str:
    return json.dumps({f: False for f in explain.INTENT_FIELDS} | changed)


# Answers of a model, and the route they give, none for those that break the contract.
PAYLOADS = (
    (_payload(needs_exact_entity=True), "entity_exact"), (_payload(needs_literal_text=True, needs_visual_semantics=True, is_compositional=True), "mixed"),
    (_payload(needs_layout_structure=True), "visual_metadata"), (_payload(needs_visual_semantics=True, confidence=0.01), "visual_discovery"), (_payload(needs_topic_discovery=True), "topic_discovery"),
    (_payload(needs_literal_text=True), "text_evidence"), (_payload(), "mixed"), (_payload(extra=True), None), (_payload(needs_literal_text=1.0), None), (_payload(needs_literal_text="true"), None),
    ('{"needs_literal_text": true}', None), ("这里是解释文字", None), ("[]", None), (_payload(confidence=2), None), (None, None),
)


@stated("n, route", ((i, r) for i, (_, r) in enumerate(PAYLOADS)))
def model_answers(spark) -> DataFrame:
    """Routes of stated model answers under their contract."""
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "n int, payload string").withColumn("e", explain.intent_fields(F.col("payload")))
    return rows.select("n", F.when(F.col("e").isNotNull(), intent.evidence_route({f: F.col(f"e.{f}") for f in explain.INTENT_FIELDS})).alias("route"))


# Queries with the route the default lexicon gives them.
SPACED_ROUTED = (
    ("森林", "visual_discovery"), ("蓝", "visual_discovery"), ("蓝色汽车", "visual_discovery"), ("图像处理 算法", "topic_discovery"), ("白板", "visual_metadata"),
    ("白板 写着 计划", "mixed"), ("提到 预算 的 页面", "text_evidence"), ("“年度报告” 照片", "visual_metadata"), ("deep learning", "topic_discovery"), ("这是 什么 东西", "mixed"),
)


@stated("query, route", SPACED_ROUTED)
def route_golden(spark) -> DataFrame:
    """Routes of a literal corpus under the default lexicon."""
    rows = spark.createDataFrame([(q,) for q, _ in SPACED_ROUTED], "query string")
    return rows.select("query", intent.route(F.col("query")).alias("route"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    made, columns, rows = CASES[name]
    got = made(spark)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_generated_corpus(spark):
    """Forty pages, twelve queries that one of them answers and four for a code that none has."""
    from tessera.plans.intent import reference_pages, reference_queries, reproduced

    pages = reference_pages(spark.range(40))
    first = pages.where("id = 0").first()
    assert (first.item, first.code, first.colour) == ("synthetic_001", "HARBOR-001", "amber") and pages.select("code").distinct().count() == 40
    asked = reference_queries(pages, F.col("id").isin(0, 2, 4, 5, 8, 11, 15, 19, 23, 27, 34, 39), F.col("id").isin(0, 6, 17, 28))
    assert tuple(reproduced(pages, asked).first()) == (1.0, 1.0, 1.0, 1.0, 16, 4)
