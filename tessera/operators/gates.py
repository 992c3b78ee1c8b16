"""Acceptance policies over rankings: thresholds, guards, discovery cut-offs, selection, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import clamp, sigmoid
from tessera.functions.text import quoted_terms
from tessera.operators.intent import RELATION_MARKS, TOGETHER_MARKS, is_composite_visual, temporal_terms

# Base acceptance thresholds.
VISUAL_MIN, TEXT_MIN, BM25_MIN = 0.45, 0.50, 4.0
# Discovery margins by route.
MARGIN_TOPIC, MARGIN_VISUAL, MARGIN_COLOUR = 0.12, 0.14, 0.35


def base_accepts(method: Column, text: Column, visual: Column, lexical: Column) -> Column:
    """Whether the first row of a ranking passes its method's thresholds."""
    t, v, b = F.coalesce(text >= TEXT_MIN, F.lit(False)), F.coalesce(visual >= VISUAL_MIN, F.lit(False)), F.coalesce(lexical >= BM25_MIN, F.lit(False))
    return F.when(method == "visual", v).when(method == "text", t).when(method == "bm25", b).otherwise(t | v | b)


def top_two(scores: DataFrame, score: str, query: str = "query") -> DataFrame:
    """``(query, top1, margin)``; a missing second value counts as -1."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc())
    ranked = scores.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    return ranked.groupBy(query).agg(
        F.max(F.when(F.col("_n") == 1, F.col(score))).alias("top1"),
        (F.max(F.when(F.col("_n") == 1, F.col(score))) - F.coalesce(F.max(F.when(F.col("_n") == 2, F.col(score))), F.lit(-1.0))).alias("margin"),
    )


def open_set_probability(features: list[Column], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    """Logistic gate over standardised features."""
    total = F.lit(bias)
    for x, m, s, w in zip(features, means, scales, weights, strict=True):
        total = total + F.lit(w) * (x - F.lit(m)) / F.lit(max(s, 1e-8))
    return sigmoid(total)


def joint_evidence(rows: DataFrame, *conditions: Column, within: int = 10) -> DataFrame:
    """``(query, joint)``: whether one row of the first ``within`` meets all conditions at once."""
    both = F.lit(True)
    for c in conditions:
        both = both & c
    return rows.where(F.col("rank") <= within).groupBy("query").agg(F.coalesce(F.bool_or(both), F.lit(False)).alias("joint"))


def discovery_rows(rows: DataFrame, score: str, *, least: float, margin: float, query: str = "query") -> DataFrame:
    """Rows whose score reaches max(least, best - margin) of their query."""
    best = F.max(score).over(Window.partitionBy(query))
    return rows.withColumn("_cut", F.greatest(F.lit(least), best - F.lit(margin))).where(F.col(score) >= F.col("_cut")).drop("_cut")


def listwise(candidates: DataFrame, method: str, *, k: int = 10, floor: float = 0.63, weight: float = 0.5, query: str = "query") -> DataFrame:
    """Selected candidate per query of rows (query, item, rank, full).

    L0: first by rank with full >= floor. L1: largest full, then rank, and it
    must reach floor. L2: largest weight / log2(rank + 1) + (1 - weight) * clip(full).
    """
    top = candidates.where(F.col("rank") <= k)
    if method == "L0":
        passed, order = top.where(F.col("full") >= floor), [F.col("rank")]
    elif method == "L1":
        passed, order = top, [F.round("full", 9).desc(), F.col("rank")]
    elif method == "L2":
        passed, order = top, [F.round(F.lit(weight) / F.log2(F.col("rank") + 1) + F.lit(1 - weight) * clamp(F.col("full")), 9).desc(), F.col("rank")]
    else:
        raise ValueError("method is L0, L1 or L2")
    first = passed.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where("_n = 1").drop("_n")
    return first.where(F.col("full") >= floor) if method == "L1" else first


def strength(score: Column, threshold: Column, full: Column) -> Column:
    """How far a raw score is between 2 threshold - full and full, within 0..1."""
    low = 2 * threshold - full
    return clamp((score - low) / F.greatest(full - low, F.lit(1e-9)))


# Between which global scores the whole query counts, and the weights of the blend.
GLOBAL_FLOOR, GLOBAL_FULL = 0.35, 0.60
BLEND = {"global": 0.20, "mean": 0.35, "geometric": 0.25, "weakest": 0.20}


def coverage(evidence: DataFrame, *, keys: list[str], compositional: Column | None = None) -> DataFrame:
    """Blend of requirement strengths per candidate of rows (keys, strength, weight, mandatory, passed, global_score).

    Only mandatory requirements count. .20 global (from 0 at .35 to 1 at .60) +
    .35 weighted mean + .25 weighted geometric mean + .20 weakest; accepted
    when none is missed. A candidate of a plan that is not compositional, or
    that has no mandatory requirement, is accepted with its global score.
    """
    must = F.col("mandatory")
    w, s = F.when(must, F.col("weight")), F.when(must, F.col("strength"))
    total = F.sum(w)
    whole = F.lit(True) if compositional is None else compositional
    rows = evidence.groupBy(*keys).agg(
        F.max("global_score").alias("global_score"),
        (F.sum(w * s) / total).alias("weighted_mean"),
        F.exp(F.sum(w * F.ln(F.greatest(s, F.lit(1e-6)))) / total).alias("weighted_geo"),
        F.min(s).alias("weakest"),
        F.avg(F.when(must, F.col("passed").cast("double"))).alias("coverage_ratio"),
        F.bool_or(whole & must).alias("enabled"),
    )
    on = F.coalesce(F.col("enabled"), F.lit(False))
    overall = clamp((F.col("global_score") - GLOBAL_FLOOR) / (GLOBAL_FULL - GLOBAL_FLOOR))
    blend = BLEND["global"] * overall + BLEND["mean"] * F.col("weighted_mean") + BLEND["geometric"] * F.col("weighted_geo") + BLEND["weakest"] * F.col("weakest")
    return rows.withColumns({
        "enabled": on, "accepted": ~on | (F.col("coverage_ratio") == 1), "coverage_ratio": F.when(on, F.col("coverage_ratio")).otherwise(1.0),
        "coverage": F.when(on, blend).otherwise(F.col("global_score")),
    })


# Words that make literal text a condition of a picture request.
LITERAL_IN_PICTURE = ("餐厅菜单", "价目表", "通知", "英文", "代码", "写着", "写有")


def route_guard(rows: DataFrame, *, dense_min: float = 0.50, lexical_min: float = 4.0, visual_min: float = 0.34, within: int = 10) -> DataFrame:
    """Evidence must meet on one candidate: ``(query, accepted, signal_name, signal)`` of (query, text, route, item, rank, dense, lexical, visual, quoted).

    ``quoted`` says whether the candidate holds every quoted term. A query
    without candidates is one row with a null item. ``accepted`` is null where
    the guard leaves the decision alone.
    """
    top = F.col("item").isNotNull() & (F.col("rank") <= within)
    dense, lexical = F.coalesce(F.col("dense"), F.lit(0.0)) >= dense_min, F.coalesce(F.col("lexical"), F.lit(0.0)) >= lexical_min
    seen = F.coalesce(F.col("visual"), F.lit(0.0)) >= visual_min
    counted = rows.groupBy("query", "text", "route").agg(
        F.count_if(top).alias("n"), F.count_if(top & F.coalesce("quoted", F.lit(False))).alias("quoted"), F.count_if(top & dense & lexical).alias("aligned"),
        F.count_if(top & seen).alias("seen"), F.count_if(top & seen & dense & lexical).alias("seen_literal"),
    )
    literal = ~F.contains("text", F.lit("手写")) & F.col("text").rlike("|".join(LITERAL_IN_PICTURE))
    demands = F.col("route").isin("text_evidence", "mixed") & (F.size(quoted_terms(F.col("text"))) > 0) & (F.col("quoted") == 0)
    visual = F.when(literal, F.col("seen_literal")).otherwise(F.col("seen")) + F.col("quoted")
    name = (
        F.when(demands, F.lit("complete_quoted_evidence_count")).when(F.col("n") == 0, F.lit("route_aligned_evidence_count"))
        .when(F.col("route") == "text_evidence", F.lit("aligned_text_bm25_candidate_count"))
        .when(F.col("route") == "visual_metadata", F.when(literal, F.lit("aligned_visual_text_candidate_count")).otherwise(F.lit("visual_metadata_candidate_count")))
    )
    signal = F.when(demands | (F.col("n") == 0), F.lit(0).cast("long")).when(F.col("route") == "text_evidence", F.col("aligned") + F.col("quoted")).when(F.col("route") == "visual_metadata", visual)
    out = counted.select("query", name.alias("signal_name"), signal.alias("signal"))
    return out.select("query", (F.col("signal") >= 1).alias("accepted"), "signal_name", "signal")


def composite_guard(rows: DataFrame, *, least: float = 0.35, related: float | None = None, within: int = 10) -> DataFrame:
    """``(query, applies, rejects)`` of (query, text, route, accepted, item, rank, visual, literal).

    A picture request that names several things needs one candidate that looks
    like it; a page with complete literal evidence lifts the guard.
    """
    top = F.col("rank") <= within
    best = rows.groupBy("query", "text", "route", "accepted").agg(
        F.coalesce(F.max(F.when(top, F.col("visual"))), F.lit(0.0)).alias("best"), F.coalesce(F.bool_or(top & F.col("literal")), F.lit(False)).alias("literal")
    )
    q = F.regexp_replace("text", r"\s+", "")
    applies = is_composite_visual(F.col("text"), F.col("route")) & ~F.col("literal")
    limit = F.when(q.rlike("|".join(RELATION_MARKS)), F.lit(least if related is None else related)).otherwise(F.lit(least))
    return best.select("query", applies.alias("applies"), (applies & F.col("accepted") & (F.col("best") < limit)).alias("rejects"))


def context_guard(rows: DataFrame, within: int = 10) -> DataFrame:
    """``(query, rejects)`` of (query, text, rank, context): a time relative to the asker needs evidence on a page of the first ten."""
    found = rows.groupBy("query", "text").agg(F.coalesce(F.bool_or((F.col("rank") <= within) & F.col("context")), F.lit(False)).alias("found"))
    return found.select("query", ((F.size(temporal_terms(F.col("text"))) > 0) & ~F.col("found")).alias("rejects"))


def attribute_guard(compositional: Column, accepted: Column, top_passed: Column) -> Column:
    """Acceptance once all requirements must hold on the first candidate; plans of one requirement are left alone."""
    return F.when(compositional, accepted & F.coalesce(top_passed, F.lit(False))).otherwise(accepted)


def entity_policy(rows: DataFrame) -> DataFrame:
    """Rows (query, item, rank, exact) of entity look-ups: only exact pages where there are any; ``accepted`` tells.

    Without an exact page all rows stay, none accepted: no similar page stands in for a name.
    """
    any_exact = rows.groupBy("query").agg(F.bool_or("exact").alias("accepted"))
    return rows.join(any_exact, "query").where(~F.col("accepted") | F.col("exact"))


def discovery_accepted(route: Column, colour: Column, best: dict[str, Column], exact_pages: Column) -> Column:
    """Whether a browsing query finds anything: by colour share, by looks, or by topic text or exact pages."""
    return (
        F.when((route == "visual_discovery") & colour.isNotNull(), best["colour"] >= 0.18)
        .when(route == "visual_discovery", best["visual"] >= 0.35)
        .otherwise((exact_pages > 0) | (best["text"] >= 0.44))
    )


def discovery_filtered(rows: DataFrame, *, query: str = "query") -> DataFrame:
    """Browsing rows (query, route, colour, pure_colour, text, visual, colour_share, exact) that are not weak beside the best of their query.

    Topics by text or exact evidence, pure colours by share, colours of things
    by share and looks, other looks by looks; other routes keep all rows.
    """
    best = rows.groupBy(query).agg(*(F.max(F.coalesce(c, F.lit(0.0))).alias(f"_{c}") for c in ("text", "visual", "colour_share")))
    near = lambda c, least, margin: F.coalesce(c, F.lit(0.0)) >= F.greatest(F.lit(least), F.col(f"_{c}") - margin)
    looks, coloured = F.col("route") == "visual_discovery", F.col("colour").isNotNull()
    keep = (
        F.when(F.col("route") == "topic_discovery", F.col("exact") | near("text", 0.44, 0.12))
        .when(looks & coloured & F.col("pure_colour"), near("colour_share", 0.18, 0.35))
        .when(looks & coloured, (F.coalesce("colour_share", F.lit(0.0)) >= 0.12) & near("visual", 0.30, 0.10))
        .when(looks, near("visual", 0.35, 0.14))
        .otherwise(True)
    )
    return rows.join(best, query).where(keep).drop("_text", "_visual", "_colour_share")


def ranking_source(query: Column, route: Column, colour: Column, exact_topic: Column, quoted: Column, sources: dict[str, str]) -> Column:
    """Which ranking a route shows; ``sources`` names others than the usual by route.

    Colours and quoted picture titles keep the usual one; a plain request for
    one picture and a topic without exact pages are routes of their own here.
    """
    plain = (
        (route == "visual_metadata") & F.trim(query).rlike("^(?:找|查找|搜索)一张") & F.btrim(query, F.lit("。！？? ")).rlike("(?:照片|图片|图像)$")
        & (F.size(quoted_terms(query)) == 0) & ~query.rlike("|".join(TOGETHER_MARKS))
    )
    key = F.when(plain, F.lit("visual_metadata_plain_object")).when((route == "topic_discovery") & ~exact_topic, F.lit("topic_discovery_without_exact")).otherwise(route)
    usual = F.lit("quality_hybrid")
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in sources.items() for x in pair)), key), usual) if sources else usual
    keeps = ((route == "visual_discovery") & colour.isNotNull()) | ((route == "visual_metadata") & quoted)
    return F.when(keeps, usual).otherwise(named)


def reranked(rows: DataFrame, *, query: str = "query") -> DataFrame:
    """Rows (query, item, rank, rerank_score): reranked ones first by score, the others after them in their order."""
    order = Window.partitionBy(query).orderBy(F.col("rerank_score").isNull(), F.round("rerank_score", 9).desc(), "rank")
    return rows.withColumn("new_rank", F.row_number().over(order))


# Directions and their opposites, the second list tried first by the newer method.
OPPOSITES = (
    ("on the back of", "on the front of"), ("in front of", "behind"), ("to the left of", "to the right of"), ("on the left of", "on the right of"), ("on the left", "on the right"), ("at the bottom of", "at the top of"),
    ("at the bottom", "at the top"), ("above", "below"), ("under", "over"), ("inside", "outside"), ("front", "rear"), ("on", "under"),
    ("上方", "下方"), ("前面", "后面"), ("左边", "右边"),
)
NEWER_OPPOSITES = (
    ("前方", "后方"), ("前面", "后面"), ("上方", "下方"), ("上面", "下面"), ("左侧", "右侧"), ("左边", "右边"), ("内部", "外部"), ("里面", "外面"), ("之上", "之下"),
    ("above", "below"), ("in front of", "behind"), ("to the left of", "to the right of"), ("inside", "outside"),
)


def opposite_relation(value: Column, newer: bool = False) -> Column:
    """The relation with its longest direction turned round; null without one."""

    def turned(pairs, otherwise: Column) -> Column:
        both = sorted((p for a, b in pairs for p in ((a, b), (b, a))), key=lambda p: len(p[0]), reverse=True)
        out = otherwise
        for marker, other in reversed(both):
            found = f"(?i)(?<![a-z0-9]){marker}(?![a-z0-9])" if marker.isascii() else marker
            # Only the first place is turned: what stands before it is taken along.
            out = F.when(value.rlike(found), F.regexp_replace(value, f"(?s)^(.*?){found}(.*)$", f"$1{other}$2")).otherwise(out)
        return out

    older = turned(OPPOSITES, F.lit(None).cast("string"))
    return turned(NEWER_OPPOSITES, older) if newer else older


def relation_holds(positive: Column, negative: Column, *, least: float, margin: float) -> Column:
    """Enough evidence for a relation, and enough more than for its opposite."""
    return (positive >= least) & (positive - negative >= margin)


def conservative(baseline: Column, model: Column, confidence: Column, least: float = 0.80) -> Column:
    """The model's label only where it differs and is sure."""
    return F.when((model != baseline) & (confidence >= least), model).otherwise(baseline)


def guarded_admission(c: dict[str, Column]) -> Column:
    """Reason a contender replaces the baseline, or the first check that stops it."""
    return (
        F.when(c["baseline_accepted"], F.lit("baseline_kept"))
        .when(c["requirements"] < 2, F.lit("too_few_requirements"))
        .when(~c["compositional"], F.lit("not_compositional"))
        .when(c["missing"] > 0, F.lit("requirement_missing"))
        .when(~c["has_relation"], F.lit("no_relation"))
        .when(c["relation_margin"] < 0.015, F.lit("relation_margin"))
        .when(c["full"] < 0.63, F.lit("full_score"))
        .when(c["gain"] < 0.05, F.lit("gain"))
        .when(c["margin"] < 0.03, F.lit("margin"))
        .otherwise(F.lit("admitted"))
    )
