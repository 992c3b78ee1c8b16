"""Deterministic query-intent routing as Column expressions over lexicons.

A lexicon is data: the defaults are the Chinese word lists of the search
domain, and every function takes another one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, quoted_terms


@dataclass(frozen=True)
class Lexicon:
    """Word lists that decide a route; a query has a list when it contains one of its words."""

    # Words that ask for text evidence.
    text_evidence: tuple[str, ...] = (
        "提到", "出现", "写着", "包含", "记录", "表格", "编号", "多少", "成绩", "课程", "公式", "关键词", "日期", "地址",
    )
    # Words that name a picture form.
    visual_form: tuple[str, ...] = (
        "图片", "照片", "画面", "截图", "海报", "自然图像", "自然图片", "自然照片", "风景", "人物照片", "动物照片",
        "建筑照片", "课件", "幻灯片", "演示文稿",
    )
    # Words that name visual structure.
    visual_structure: tuple[str, ...] = (
        "广告牌", "街景", "白板", "流程图", "柱状图", "折线图", "图表", "仪表盘", "菜单栏", "工具栏", "搜索框", "定位标记",
        "商店招牌", "路牌", "印章", "签字栏", "日期栏", "复选框", "表格边框", "填写栏", "倾斜拍摄", "阴影遮挡", "三栏排版",
        "登录界面", "错误提示", "弹窗", "命令行窗口", "手写", "包装盒", "菜单", "价目表", "通知截图", "全家福", "购物清单",
        "自行车", "放风筝", "帽子", "帐篷",
    )
    # Words that ask for literal text.
    strong_literal: tuple[str, ...] = (
        "提到", "写着", "写有", "文字", "英文", "代码", "姓名", "地址", "日期", "时间", "地点", "金额", "标题", "关键词",
        "课程", "记录", "计划",
    )
    # Words of visual topics.
    visual_discovery: tuple[str, ...] = (
        "蓝色", "红色", "绿色", "黄色", "黑色", "白色", "紫色", "粉色", "橙色", "灰色", "棕色", "青色", "美丽", "漂亮",
        "好看", "风景", "森林", "山林", "山景", "山水", "山水画", "风景画", "自然", "感觉", "类似", "天空", "白云", "蓝天",
        "山峰", "雪山", "湖泊", "海边", "海面", "沙滩", "树木", "日出", "日落", "夕阳", "倒影", "动物", "建筑", "车辆",
        "帆船", "花朵", "树林", "草原", "田野", "河流", "瀑布", "沙漠", "峡谷", "大海", "海洋", "海岸", "雪景", "城市夜景",
        "夜景", "公园", "花园", "草地", "猫", "狗", "鸟", "跑车", "火车", "轮船", "肖像", "天地",
    )
    # Words of technical topics.
    technical: tuple[str, ...] = (
        "研究", "工程", "算法", "模型", "系统", "方法", "理论", "数据", "课程", "论文", "语言处理", "图像处理", "识别",
        "检测", "分类", "分析", "训练", "生态学", "建筑学", "动物学",
    )
    # Question words.
    question: tuple[str, ...] = (
        "哪张", "哪份", "哪些", "什么", "谁", "是否", "多少", "怎么", "怎样", "为何", "为什么", "如何", "哪里", "何时",
        "有没有",
    )
    # Times relative to the asker.
    temporal: tuple[str, ...] = (
        "我去年", "我上个月", "我上周", "我昨天", "我昨晚", "去年", "上个月", "上周", "昨天", "昨晚",
    )
    # Colours and their names; the first, of one character, counts only as the whole query.
    colours: tuple[tuple[str, str, tuple[str, ...]], ...] = (
        ("blue", "蓝", ("蓝色",)), ("red", "红", ("红色",)), ("green", "绿", ("绿色",)), ("yellow", "黄", ("黄色",)), ("black", "黑", ("黑色",)),
        ("white", "白", ("白色",)), ("purple", "紫", ("紫色",)), ("pink", "粉", ("粉色", "粉红色")), ("orange", "橙", ("橙色",)),
        ("gray", "灰", ("灰色", "灰白色")), ("brown", "棕", ("棕色", "褐色")), ("cyan", "青", ("青色", "青蓝色")),
    )
    # Words that start like a name and are none; what a segmenter's dictionary would tell, so a parameter.
    no_names: tuple[str, ...] = ("蓝牙", "白血病", "高速公路")
    # Beginnings that mark a short query as an exact entity; without any, personal names are looked for.
    entities: tuple[str, ...] = ()


DEFAULT = Lexicon()
# Punctuation that may stand at the ends of a query.
EDGE = "，。！？?：:；;、\"'“”‘’"


def spaced(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def bare(query: Column) -> Column:
    """Without white space and edge punctuation."""
    return F.btrim(F.regexp_replace(query, r"\s+", ""), F.lit(EDGE))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of ``words`` occurs; a look at the first character spares trying them all at every place."""
    if not words:
        return F.lit(False)
    first = "".join(re.escape(c) for c in sorted({w[0] for w in words}))
    return text.rlike(f"(?=[{first}])(?:{'|'.join(map(re.escape, words))})")


def colour_intent(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The one colour a query asks for; null for none or several."""


    def one(q: Column) -> Column:
        found = F.array_compact(F.array(*(F.when(has_any(q, long) | (q == short), F.lit(name)) for name, short, long in lexicon.colours)))
        return bound(found, lambda names: F.when(F.size(names) == 1, F.get(names, F.lit(0))))

    every = tuple(dict.fromkeys(w for _, short, long in lexicon.colours for w in (short, *long)))
    return F.when(has_any(query, tuple(w[:1] for w in every)), bound(bare(query), one))


# Surnames, the longer ones first.
COMPOUND_SURNAMES = ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "司徒", "司空", "令狐", "轩辕", "宇文", "长孙", "南宫", "夏侯")
SURNAMES = (
    "赵钱孙李周吴郑王冯陈蒋沈韩杨朱秦许何吕施张孔曹严华金魏陶姜"
    "谢邹喻柏窦章云苏潘葛范彭鲁韦昌马苗方俞任袁柳鲍史唐费廉岑"
    "薛雷贺倪汤滕殷罗毕郝邬安常乐于傅皮卞齐康伍余顾孟平黄和"
    "穆萧尹姚邵汪祁毛禹狄米贝明臧计伏成戴宋茅庞熊纪舒屈项祝"
    "董梁杜阮蓝闵席季麻强贾路娄江童颜郭梅盛林刁钟徐邱骆高夏"
    "蔡田樊胡凌霍虞万柯管卢莫房裘解应宗丁宣邓郁单杭洪包诸左"
    "石崔吉龚程邢裴陆荣翁羊惠甄曲封储靳段富巫乌焦巴牧山谷车"
    "侯全班仰秋仲伊宫宁栾甘厉祖武符刘景詹束龙叶幸司黎薄宿白"
    "怀蒲鄂索赖卓屠蒙池乔谭贡劳姬申扶冉桑桂牛寿通边燕冀浦尚"
    "农温庄晏柴瞿阎慕连茹习艾鱼容向古易慎戈廖耿满弘匡国文寇"
    "广聂晁冷辛简饶曾沙关游权盖桓欧沃利蔚越师巩敖融"
)
# Words around a name in a request, words that say a name follows, and ends of words that are no names.
NAME_LEAD = ("请搜索", "搜索", "请查找", "查找", "查一下", "找一下", "找", "查")
NAME_TAIL = ("的相关资料", "相关资料", "的资料", "的信息", "的照片", "的图片", "是谁", "资料", "照片", "图片")
PERSON_WORDS = ("姓名", "人名", "这个人", "人物", "是谁")
NO_NAME_TAIL = ("工程", "系统", "模型", "算法", "数据", "网络", "技术", "方法", "理论", "数学", "力学", "化学", "物理", "林业", "农业", "工业", "程式", "马达", "性能", "质量", "水平", "荣耀")
CALLED = r"(?:叫|名为|姓名(?:是|为)|人名(?:是|为))([\x{3400}-\x{9fff}]{2,4}?)(?=的人|这个人|是谁|[，。！？?：:；;、]|$)"
SURNAME = f"(?>{'|'.join(COMPOUND_SURNAMES)}|[{SURNAMES}])"


def strict_entity(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A personal name of two to four characters that the query asks for, else null.

    Known topics and ends of technical words win over a surname, unless the
    query speaks of a person.
    """

    def asked(q: Column) -> Column:
        called = F.regexp_extract(q, CALLED, 1)
        name = F.when(called != "", called).otherwise(q)
        return F.regexp_replace(F.regexp_replace(name, f"^(?:{'|'.join(NAME_LEAD)})", ""), f"(?:{'|'.join(NAME_TAIL)})$", "")

    def judged(q: Column) -> Column:
        person = has_any(q, PERSON_WORDS)
        topics = tuple(w for w in lexicon.visual_discovery if len(w) > 1)

        def name(c: Column) -> Column:
            other = has_any(c, topics) | c.isin(*lexicon.no_names) | c.rlike(f"(?:{'|'.join(NO_NAME_TAIL)})$")
            return F.when(c.rlike(r"^[\x{3400}-\x{9fff}]{2,4}$") & c.rlike(f"^{SURNAME}") & (person | ~other), c)

        return bound(asked(q), name)

    # A name is short, so a long query can only hold one that it announces.
    return F.when(query.rlike(r"[\x{3400}-\x{9fff}]{2}"), bound(bare(query), judged))


def entity_term(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The name a query asks for; with ``lexicon.entities``, a short query that starts with one of them. Else null."""
    if not lexicon.entities:
        return strict_entity(query, lexicon)
    starts = f"^(?:{'|'.join(map(re.escape, lexicon.entities))})"
    return bound(bare(query), lambda q: F.when((F.char_length(q).between(2, 12)) & q.rlike(starts), q))


def is_visual_discovery(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return bound(spaced(query), lambda q: _visual_discovery(q, lexicon))


def _visual_discovery(q: Column, lexicon: Lexicon) -> Column:
    technical = has_any(q, lexicon.technical) & ~has_any(q, lexicon.visual_form)
    asks = ~has_any(q, lexicon.text_evidence) & entity_term(q, lexicon).isNull()
    return asks & (colour_intent(q, lexicon).isNotNull() | (~technical & has_any(q, lexicon.visual_discovery)))


def is_keyword(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A short topic phrase: no question, no evidence word, plain characters only."""
    q = F.btrim(spaced(query), F.lit(EDGE))
    plain = q.rlike(r"^[\x{3400}-\x{9fff}A-Za-z0-9+#.\-\s]+$")
    asks = has_any(q, lexicon.text_evidence) | has_any(q, lexicon.question) | entity_term(q, lexicon).isNotNull()
    return (F.char_length(q).between(1, 16)) & plain & ~asks


def route(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Evidence route of a query; earlier rules win. The query is put in order once, however many rules read it."""
    return bound(spaced(query), lambda q: _route(q, lexicon))


def _route(q: Column, lexicon: Lexicon) -> Column:
    quoted = F.size(quoted_terms(q)) > 0
    form = has_any(q, lexicon.visual_form)
    return (
        F.when(has_any(q, lexicon.visual_structure), F.when(has_any(q, lexicon.strong_literal), F.lit("mixed")).otherwise(F.lit("visual_metadata")))
        .when(has_any(q, lexicon.text_evidence), F.lit("text_evidence"))
        .when(quoted & form, F.lit("visual_metadata"))
        .when(is_visual_discovery(q, lexicon), F.lit("visual_discovery"))
        .when(entity_term(q, lexicon).isNotNull(), F.lit("entity_exact"))
        .when(form, F.lit("visual_metadata"))
        .when(is_keyword(q, lexicon), F.lit("topic_discovery"))
        .otherwise(F.lit("mixed"))
    )


def branches(method: Column, routed: Column, exploratory: Column) -> Column:
    """Which of the text, lexical and visual branches a search needs."""
    flags = lambda t, b, v: F.struct(t.alias("text"), b.alias("bm25"), v.alias("visual"))
    yes, no = F.lit(True), F.lit(False)
    gate_needs_all = (method == "quality_hybrid") & ~exploratory
    return (
        F.when(method == "text", flags(yes, no, no))
        .when(method == "visual", flags(no, no, yes))
        .when(routed.isin("entity_exact", "text_evidence"), flags(yes, yes, no))
        .when((routed == "visual_discovery") | gate_needs_all, flags(yes, yes, yes))
        .otherwise(flags(yes, routed.isin("topic_discovery", "mixed"), routed.isin("visual_metadata", "mixed")))
    )


def evidence_route(e: dict[str, Column]) -> Column:
    """Route from stated needs: an entity first, then literal text beside a picture, then single needs."""
    literal, seen = e["needs_literal_text"], e["needs_visual_semantics"] | e["needs_layout_structure"]
    return (
        F.when(e["needs_exact_entity"], F.lit("entity_exact"))
        .when(literal & seen, F.lit("mixed"))
        .when(e["needs_layout_structure"], F.lit("visual_metadata"))
        .when(e["needs_visual_semantics"], F.lit("visual_discovery"))
        .when(e["needs_topic_discovery"], F.lit("topic_discovery"))
        .when(literal, F.lit("text_evidence"))
        .otherwise(F.lit("mixed"))
    )


# Request words that are no topic, and pieces too general to be one.
TOPIC_NOISE = (
    "请帮我", "请查找", "查找", "搜索", "找一下", "找一张", "找一页", "找", "标题里面", "标题里", "标题中", "哪一页", "那一页", "文档", "文件", "资料", "页面", "图片", "照片",
    "截图", "课件", "演示页面", "演示文稿", "幻灯片", "查到", "带有", "包含", "提到", "介绍", "列出", "展示", "显示", "写有", "写着",
)
GENERAL_PIECES = ("一张", "一页", "一个", "学术", "技术", "正式", "旧")


def _without(text: Column, words) -> Column:
    for w in sorted(words, key=len, reverse=True):
        text = F.replace(text, F.lit(w), F.lit(" "))
    return text


def topic_terms(query: Column) -> Column:
    """Literal phrases of a topic request, without the words of the request; a list's subject counts beside the list."""
    pieces = F.split(_without(bare(query), TOPIC_NOISE), "以及|并且|同时|和|与|或|、|的|里|中")
    clean = F.transform(pieces, lambda p: F.regexp_replace(F.trim(p), "^(?:有|含|带)", ""))
    said = F.filter(clean, lambda p: (F.char_length(p) >= 2) & ~p.isin(*GENERAL_PIECES))
    cored = F.transform(said, lambda p: F.when(F.endswith(p, F.lit("列表")) & (F.char_length(p) > 4), F.array(p, F.regexp_replace(p, "列表$", ""))).otherwise(F.array(p)))
    return F.array_distinct(F.flatten(cored))


def temporal_terms(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Times relative to the asker that a query names, in the lexicon's order."""
    return bound(F.regexp_replace(query, r"\s+", ""), lambda q: F.filter(F.array(*map(F.lit, lexicon.temporal)), lambda t: F.contains(q, t)))


# Words of a request for nothing but a colour.
COLOUR_FILLERS = ("请", "帮我", "查找", "搜索", "找", "一张", "图片", "照片", "画面", "颜色", "色调", "为主", "主要", "的")


def is_pure_colour(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Whether a query names one colour and nothing else."""

    def rest(q: Column) -> Column:
        for w in COLOUR_FILLERS:
            q = F.replace(q, F.lit(w), F.lit(""))
        return q

    intent = colour_intent(query, lexicon)
    left = F.lit(None).cast("string")
    for name, short, long in lexicon.colours:
        every = "|".join(map(re.escape, sorted((short, *long), key=len, reverse=True)))
        left = F.when(intent == name, F.regexp_replace(rest(bare(query)), every, "")).otherwise(left)
    return F.coalesce(left == "", F.lit(False))


# What a visual request is widened to.
COLOUR_SCENES = {name: f"以{long[0]}为主要色调，具有大面积明显{long[0]}区域的真实图片" for name, _, long in DEFAULT.colours} | {"cyan": "以青色或青蓝色为主要色调的真实图片"}
SKY_AND_LAND = "广阔天空与大地同框的自然风景，天空、地面、山川或原野清晰可见"
BEAUTY = "美丽的自然风景，青山、森林、湖泊、花朵和令人愉悦的真实画面"
FOREST = "茂密的绿色森林，树木、山林和自然风景的真实照片"
RELATED = "，与该主题直接相关、主体清晰的真实图片"
BOTH = "，主体内容必须匹配，同时要求"


def expanded_visual(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A visual request in concrete words; others as they are."""
    q, colour = spaced(query), colour_intent(query, lexicon)
    scene = F.element_at(F.create_map(*(F.lit(x) for pair in COLOUR_SCENES.items() for x in pair)), colour)
    return (
        F.when(~is_visual_discovery(query, lexicon), q)
        .when(colour.isNotNull(), F.when(is_pure_colour(query, lexicon), scene).otherwise(F.concat(q, F.lit(BOTH), scene)))
        .when(F.contains(q, F.lit("天地")), F.lit(SKY_AND_LAND))
        .when(has_any(q, ("美丽", "漂亮", "好看")), F.lit(BEAUTY))
        .when(F.contains(q, F.lit("森林")), F.lit(FOREST))
        .otherwise(F.concat(q, F.lit(RELATED)))
    )


def search_intent(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``(route, exploratory, search_query, entity)`` of a query."""
    routed, entity = route(query, lexicon), entity_term(query, lexicon)
    exact = (routed == "entity_exact") & entity.isNotNull()
    visual = routed == "visual_discovery"
    return F.struct(
        routed.alias("route"),
        (~exact & (visual | (routed == "topic_discovery"))).alias("exploratory"),
        F.when(visual, expanded_visual(query, lexicon)).otherwise(query).alias("search_query"),
        F.when(exact, entity).alias("entity"),
    )


# Marks of literal text, of looks, of layout, of pictures and of look-ups in a query.
LITERAL_MARKS = ("写着", "写有", "提到", "显示", "标题", "说明", "标签", "号码", "型号", "标注", "文字", "正文", "包含", "字样")
LOOKS_MARKS = ("照片", "画面", "红色", "蓝色", "绿色", "白色", "黄色", "金色", "穿", "外墙", "徽章", "印章", "标志", "球衣", "瓶子", "路牌", "胸牌")
LAYOUT_MARKS = ("左边", "右边", "左侧", "右侧", "左上角", "右上角", "下方", "顶部", "底部", "申请表", "清单", "界面", "截图", "柱状图", "折线图", "时间轴", "地图", "节点", "证书")
PICTURE_MARKS = ("照片", "图片", "画面", "图中", "哪张图", "一张图", "的图")
LOOKUP_MARKS = ("查", "找", "定位", "检索", "有没有", "在哪")
PLACE_ONLY_MARKS = ("标题写着", "说明文字")
CODE = "(?<![A-Za-z0-9])[A-Za-z]{1,8}[-_]?[0-9]{1,8}(?![A-Za-z0-9])"
BEFORE_NAME = ("查", "查一下", "查到", "找", "定位", "检索", "有没有", "看看")
AFTER_NAME = ("吗", "出现", "在哪", "对应", "的记录", "有没有", "被提到")
# What a query holds when text on the page is a condition.
PAGE_TEXT_MARKS = (
    "写着", "写有", "提到", "文字", "标题", "标签", "号码", "编号", "型号", "姓名", "国籍", "学校", "日期", "金额", "总额", "标价", "表格", "单元格", "正文", "通知", "发票", "小票",
)


def _literal(q: Column) -> Column:
    return has_any(q, LITERAL_MARKS) | q.rlike("[“”「」A-Za-z0-9]")


def has_compound_evidence(query: Column) -> Column:
    """Whether a query plainly asks for two of literal text, looks and layout."""
    literal, looks, layout = _literal(query), has_any(query, LOOKS_MARKS), has_any(query, LAYOUT_MARKS)
    only_place = literal & layout & ~looks & has_any(query, PLACE_ONLY_MARKS)
    return ~only_place & ((literal & looks) | (literal & layout) | (looks & layout))


def is_pure_scene(query: Column, routed: Column) -> Column:
    """A picture request without literal text or layout that was routed as mixed."""
    return (routed == "mixed") & has_any(query, PICTURE_MARKS) & ~_literal(query) & ~has_any(query, LAYOUT_MARKS)


def is_short_code(query: Column, routed: Column) -> Column:
    """A short look-up of a product or document code."""
    q = bare(query)
    plain = ~has_any(query, LOOKS_MARKS) & ~has_any(query, LAYOUT_MARKS)
    return (routed == "mixed") & (F.char_length(q) <= 18) & q.rlike(CODE) & plain & has_any(query, LOOKUP_MARKS)


def is_missed_person(query: Column) -> Column:
    """Whether a query reads like a look-up of a person: a surname with one or two characters between words of a look-up."""
    before, after = "|".join(BEFORE_NAME), "|".join(AFTER_NAME)
    no_name = "|".join(NO_NAME_TAIL)
    # What stands before the name is nothing or ends in a look-up word; what stands after is nothing or starts with one.
    pattern = f"(?:^|(?:{before})){SURNAME}.{{1,2}}(?<!{no_name})(?:$|(?={after}))"

    def judged(q: Column) -> Column:
        hinted = (F.char_length(q) <= 4) | has_any(q, (*BEFORE_NAME, *AFTER_NAME, "名单"))
        return (q != "") & hinted & q.rlike(pattern)

    return F.coalesce(bound(bare(query), judged), F.lit(False))


def ambiguity(query: Column, routed: Column) -> Column:
    """Reasons for asking a model about a route the rules gave."""
    compound = has_compound_evidence(query)
    reasons = F.array(
        F.when((routed == "mixed") & ~compound, F.lit("rule_route_mixed")).when((routed != "mixed") & compound, F.lit("explicit_compound_evidence_missed_by_rule")),
        F.when(routed.isin("text_evidence", "topic_discovery", "mixed") & is_missed_person(query), F.lit("probable_person_lookup_missed_by_rule")),
    )
    return F.array_compact(reasons)


def calibrated_route(query: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The rules' route, with persons, codes and plain picture requests recovered."""

    def recovered(r: Column) -> Column:
        person = r.isin("text_evidence", "topic_discovery", "mixed") & (F.char_length(bare(query)) <= 18) & is_missed_person(query)
        return F.when(person | is_short_code(query, r), F.lit("entity_exact")).when(is_pure_scene(query, r), F.lit("visual_discovery")).otherwise(r)

    return bound(route(query, lexicon), recovered)


def requires_page_text(query: Column) -> Column:
    """Whether text on the page itself is an explicit condition."""
    return has_any(query, PAGE_TEXT_MARKS) | query.rlike("[“”「」]")


def guarded_model_route(query: Column, rule: Column, model: Column) -> Column:
    """``(route, reason)``: the model's route, unless it would drop pictures without need or calls a long query an entity."""
    free = ~requires_page_text(query)
    narrow = ((rule == "visual_discovery") & model.isin("text_evidence", "mixed")) | ((rule == "mixed") & (model == "text_evidence"))
    long = (model == "entity_exact") & (F.char_length(bare(query)) > 16)
    reason = F.when(free & narrow, F.lit("preserve_visual_route_without_literal_requirement")).when(long, F.lit("reject_entity_route_for_long_compound_query"))
    return F.struct(F.when(reason.isNotNull(), rule).otherwise(model).alias("route"), reason.alias("reason"))


def hybrid_route(query: Column, rule: Column, ambiguous: Column, model: Column) -> Column:
    """``(route, source, reason)``: the rule where it is clear or the model failed (null), else the guarded model."""
    guarded = guarded_model_route(query, rule, model)
    return (
        F.when(~ambiguous, F.struct(rule.alias("route"), F.lit("rule").alias("source"), F.lit(None).cast("string").alias("reason")))
        .when(model.isNull(), F.struct(rule.alias("route"), F.lit("rule_fallback").alias("source"), F.lit(None).cast("string").alias("reason")))
        .otherwise(F.struct(guarded["route"].alias("route"), F.when(guarded["reason"].isNotNull(), F.lit("rule_guard")).otherwise(F.lit("llm")).alias("source"), guarded["reason"].alias("reason")))
    )


def transition_guard(method: Column, old: Column, new: Column, compositional: Column, entity: Column) -> Column:
    """``(route, reason)``: the new route, or the old one if the new would drop safety the old has.

    ``entity`` is the strict entity of the query, ``compositional`` null where no evidence is known.
    """
    discovery = ("topic_discovery", "visual_discovery")
    was, will = branches(method, old, old.isin(*discovery)), branches(method, new, new.isin(*discovery))
    drops = (was["text"] & ~will["text"]) | (was["bm25"] & ~will["bm25"]) | (was["visual"] & ~will["visual"])
    reason = (
        F.when(~old.isin(*discovery) & new.isin(*discovery), F.lit("preserve_factual_acceptance"))
        .when((new == "entity_exact") & entity.isNull(), F.lit("entity_exact_without_strict_term"))
        .when(F.coalesce(compositional, F.lit(False)) & drops, F.lit("compositional_candidate_removes_legacy_branch"))
        .when(drops, F.lit("candidate_removes_legacy_branch"))
    )
    return F.struct(F.when(reason.isNotNull(), old).otherwise(new).alias("route"), reason.alias("reason"))


# Marks that several things are pictured together; the relational ones are the stronger.
RELATION_MARKS = ("戴着", "搭着", "放着", "摆放", "飞越", "游过", "停在", "站在", "穿过", "驶过", "跃过", "降落", "围着", "顶着", "堆成", "坐在", "举着", "趴在", "装进", "挂在")
TOGETHER_MARKS = ("和", "与", "以及", "同时", "并且", "、", "旁", "旁边", "戴着", "戴", "搭着", "放着", "摆放", "上写着", "下的", "飞越", "游过", "停在", "站在", "穿过", "驶过", "跃过", "降落", "围着", "顶着", "堆成", "坐在", "举着", "趴在", "装进", "挂在")


def is_composite_visual(query: Column, routed: Column) -> Column:
    """Visual requests of eight characters or more that name more than one pictured thing."""
    q = F.regexp_replace(query, r"\s+", "")
    return routed.isin("mixed", "visual_metadata", "visual_discovery") & (F.char_length(q) >= 8) & has_any(q, TOGETHER_MARKS)
