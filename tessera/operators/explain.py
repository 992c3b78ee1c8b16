"""Why a page was found: query terms, matched terms, the branch that spoke loudest; and model backends behind a contract."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bound, char_ngrams, excerpt, normalized_query

# Runs of a query, words that separate its terms, and pieces that say nothing.
RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+|[A-Za-z0-9][A-Za-z0-9._:+/-]*"
BETWEEN = "哪张|哪份|哪些|图片|图像|照片|文档|资料|页面|展示|显示|包含|出现|找到|查找|搜索|内容|是什么|什么|的|了|和|与|中|里|上"
EMPTY_PIECES = ("这张", "这个", "那个", "一张", "一份", "有关", "相关")


def query_terms(query: Column) -> Column:
    """Literal terms of a query: Latin runs, and Chinese pieces with the bigrams of longer ones."""
    none = F.array().cast("array<string>")

    def of_piece(p: Column) -> Column:
        return F.when((F.char_length(p) < 2) | p.isin(*EMPTY_PIECES), none).when(F.char_length(p) >= 4, F.concat(F.array(p), char_ngrams(p, 2))).otherwise(F.array(p))

    def of_run(r: Column) -> Column:
        latin = F.when(F.char_length(r) >= 2, F.array(F.lower(r))).otherwise(none)
        return F.when(r.rlike(r"^[\x{3400}-\x{9fff}]"), F.flatten(F.transform(F.split(r, BETWEEN), of_piece))).otherwise(latin)

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(query, F.lit(RUN), F.lit(0)), of_run)))


def matched_terms(query: Column, text: Column) -> Column:
    """Terms of the query that the text holds, whatever their case."""
    return bound(F.lower(text), lambda low: F.filter(query_terms(query), lambda t: F.contains(low, F.lower(t))))


def dominant_branch(row: Mapping[str, Column]) -> Column:
    """The kind of evidence that decided: a reranker, the route's own, else the largest score (text before words before looks before colour)."""
    scores = [F.coalesce(row[c], F.lit(0.0)) for c in ("text", "bm25", "visual", "colour")]
    largest = F.greatest(*scores)
    by_score = F.when(scores[0] == largest, "text").when(scores[1] == largest, "words").when(scores[2] == largest, "visual").otherwise("colour")
    coloured = F.when(row["pure_colour"], F.lit("colour")).otherwise("visual_and_colour")
    return (
        F.when(row["rerank"].isNotNull(), F.lit("rerank"))
        .when(row["route"] == "visual_discovery", F.when(row["colour_intent"].isNotNull(), coloured).otherwise("visual"))
        .when(row["route"] == "visual_metadata", F.lit("metadata_and_visual"))
        .otherwise(by_score)
    )


def explanation(query: Column, text: Column, row: Mapping[str, Column], most: int = 8) -> Column:
    """``(branch, terms, excerpt)`` of one result; no terms, no excerpt."""
    return bound(
        matched_terms(query, text),
        lambda terms: F.struct(
            dominant_branch(row).alias("branch"), F.slice(terms, 1, most).alias("terms"), F.when(F.size(terms) > 0, excerpt(text, terms)).otherwise("").alias("excerpt")
        ),
    )


# ---- model backends

# Fields a model's intent must have, and the one it may have.
INTENT_FIELDS = ("needs_literal_text", "needs_visual_semantics", "needs_layout_structure", "needs_exact_entity", "needs_topic_discovery", "is_compositional")
CONFIDENCE = "confidence"


def intent_fields(payload: Column) -> Column:
    """A model's answer as booleans, null unless it is one object with just these fields, all true or false, and a confidence within 0..1 if any."""
    keys = F.json_object_keys(payload)
    exact = (F.size(F.array_except(F.array(*map(F.lit, INTENT_FIELDS)), keys)) == 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, (*INTENT_FIELDS, CONFIDENCE))))) == 0)
    value = lambda f: F.get_json_object(payload, f"$.{f}")
    boolean = F.lit(True)
    for f in INTENT_FIELDS:
        # A quoted "true" is no boolean: the raw text tells them apart.
        boolean = boolean & payload.rlike(rf'"{f}"\s*:\s*(?:true|false)\b')
    share = F.array_contains(keys, CONFIDENCE)
    sure = ~share | value(CONFIDENCE).isNull() | F.coalesce(F.try_to_number(value(CONFIDENCE), F.lit("9.999999")).between(0, 1), F.lit(False))
    made = F.struct(*((value(f) == "true").alias(f) for f in INTENT_FIELDS))
    return F.when(F.coalesce(exact & boolean & sure, F.lit(False)), made)


def backend_answers(queries: DataFrame, backend: Callable[[list[str]], list[str | None]], *, query: str = "query", cache: DataFrame | None = None) -> DataFrame:
    """``(query, payload)``: the backend's answer to every distinct query in normal form; what a cache holds is not asked again.

    ``backend`` takes a list of queries where a task runs and gives as many
    answers; an exception is an answer of null for its batch, never a failed job.
    """
    asked = queries.select(normalized_query(F.col(query)).alias("query")).where("query != ''").distinct()
    fresh = asked if cache is None else asked.join(cache.select("query"), "query", "left_anti")

    def answer(batches):
        for batch in batches:
            listed = batch["query"].tolist()
            try:
                said = backend(listed)
            except Exception:  # the rules' route stands in for a backend that fails
                said = [None] * len(listed)
            yield pd.DataFrame({"query": listed, "payload": said})

    made = fresh.mapInPandas(answer, "query string, payload string")
    return made if cache is None else made.unionByName(cache.join(asked, "query", "left_semi").select("query", "payload"))


# ---- small searches and library tables


def best_assignment(sizes: Mapping[str, Mapping[str, int]], targets: Mapping[str, Mapping[str, int]], shares: Mapping[str, float], tie: Callable[[str], float]) -> dict[str, str]:
    """The split of each group that keeps every category within its targets and comes nearest to the shares; all choices are tried.

    For the few groups of several items only: the choices grow with splits to
    the power of groups.
    """
    groups, total = sorted(sizes), {}
    for parts in sizes.values():
        for c, n in parts.items():
            total[c] = total.get(c, 0) + n
    best = None
    for splits in product(shares, repeat=len(groups)):
        used: dict = {}
        for g, s in zip(groups, splits):
            for c, n in sizes[g].items():
                used[c, s] = used.get((c, s), 0) + n
        if any(n > targets[c][s] for (c, s), n in used.items()):
            continue
        miss = sum((used.get((c, s), 0) / n - shares[s]) ** 2 for c, n in total.items() if n for s in shares)
        key = (round(miss, 12), tie("|".join(f"{g}:{s}" for g, s in zip(groups, splits))))
        if best is None or key < best[0]:
            best = key, dict(zip(groups, splits))
    if best is None:
        raise ValueError("no assignment keeps all targets")
    return best[1]


def enriched(manifest: DataFrame, source: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """The manifest with a source table's columns where the key is known; ``matched`` tells."""
    new = source.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("matched"))
    rows = manifest.join(new, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    kept = [c for c in manifest.columns if c not in set(columns)]
    return rows.select(*kept, *(F.when(F.col("matched"), F.col(f"_{c}")).otherwise(F.col(c) if c in manifest.columns else F.lit(None)).alias(c) for c in columns), "matched")


def unmatched(manifest: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows that the manifest lacks; must be empty."""
    return source.join(manifest.select(key).distinct(), key, "left_anti")


def canonical_hash(row: Column) -> Column:
    """SHA-256 of a map's JSON with keys in order, so equal contents have equal hashes."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(row)))), 256)


def feature_vector(parts: Iterable[Column]) -> Column:
    """One array of doubles from numbers and arrays, in order; missing numbers are 0."""
    return F.flatten(F.array(*parts))
