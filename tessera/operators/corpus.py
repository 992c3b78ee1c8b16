"""Corpus construction: lines, chunks, page quality, privacy scans, taxonomy routes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import bound

# What a privacy scan looks for, in text with single blanks.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
LONG_NUMBER = r"[0-9][0-9 -]{7,}[0-9]"
PRIVATE_WORDS = r"(?i)身份证|公民身份|住址|出生|姓名|手机号|电话|邮箱|\baddress\b|\bphone\b|\be-?mail\b|\bdate of birth\b|\bssn\b|\bsocial security\b"
# Words of identity papers, and the category they suggest.
IDENTITY_WORDS = r"(?i)身份证|公民身份号码|居民身份证|\bidentity card\b|\bid card\b"
IDENTITY_CATEGORY = "table_form_ticket"


def lines(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, line, text)``: non-blank lines, numbered from 0 over all lines."""
    split = F.split(F.coalesce(text_col, F.lit("")), "\n")
    return items.select(F.col(id_col).alias("item"), F.posexplode(split).alias("line", "text")).where(F.trim("text") != "")


def chunk_places(lengths: list[int], limit: int = 400, overlap: int = 2) -> list[tuple[int, int]]:
    """(first, last) line of each greedy chunk.

    Lines are added while the characters stay within ``limit``, never fewer
    than one; the next chunk starts ``overlap`` lines back, at least one line
    further than the last start. One pass: at most ``overlap`` lines are read again.
    """
    out, first, n = [], 0, len(lengths)
    while first < n:
        last, total = first, lengths[first]
        while last + 1 < n and total + lengths[last + 1] <= limit:
            last += 1
            total += lengths[last]
        out.append((first, last))
        if last == n - 1:
            break
        first = max(first + 1, last + 1 - overlap)
    return out


def packed_chunks(line_texts: Column, limit: int = 400, overlap: int = 2) -> Column:
    """Greedy chunks of an array of lines: array of (first, last) line numbers.

    Where a chunk starts depends on where the last one ended, so the lengths of
    a document's lines (not the lines) go through an Arrow batch.
    """

    @pandas_udf("array<struct<first:int,last:int>>")
    def placed(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: [{"first": a, "last": b} for a, b in chunk_places(x.tolist(), limit, overlap)] if x is not None else [])

    return placed(F.transform(line_texts, F.char_length))


def chunk_table(items: DataFrame, id_col: str, text_col: str, limit: int = 400, overlap: int = 2) -> DataFrame:
    """``(item, chunk, first_line, last_line, text)`` with chunk numbers from 0."""
    kept = F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = items.select(F.col(id_col).alias("item"), kept.alias("ls")).withColumn("cs", packed_chunks(F.col("ls"), limit, overlap))
    each = rows.select("item", "ls", F.posexplode("cs").alias("chunk", "c"))
    text = F.array_join(F.slice("ls", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "\n")
    return each.select("item", "chunk", F.col("c.first").alias("first_line"), F.col("c.last").alias("last_line"), text.alias("text"))


def contains_sensitive(text: Column) -> Column:
    """Whether a text names private data: its words, an address, or a number of nine digits, blanks and dashes or more."""
    return bound(F.regexp_replace(text, r"\s+", " "), lambda t: t.rlike(PRIVATE_WORDS) | t.rlike(EMAIL) | t.rlike(LONG_NUMBER))


def risk_score(expected: Column, confidence: Column, low_share: Column, chars: Column) -> Column:
    """Recognition risk of a page: how doubtful its text is where text is expected, how much there is where not."""
    sparse = F.greatest(F.lit(0.0), (F.lit(50.0) - chars) / 50.0)
    return F.when(expected, 0.55 * (1 - confidence) + 0.25 * low_share + 0.20 * sparse).otherwise(
        0.5 + 0.5 * F.least(chars / 30.0, F.lit(1.0)) * confidence
    )


def quality_route(*, expected: Column, chars: Column, boxes: Column, confidence: Column, private: Column, sensitive: Column) -> Column:
    return (
        F.when(private & sensitive, F.lit("privacy_review"))
        .when(~expected & (chars >= 6) & (confidence >= 0.70), F.lit("category_text_leak"))
        .when(~expected & (chars >= 3) & (confidence >= 0.50), F.lit("category_review"))
        .when(~expected, F.lit("pass"))
        .when((chars == 0) | (boxes == 0), F.lit("ocr_retry"))
        .when(confidence < 0.60, F.lit("ocr_low_confidence"))
        .otherwise(F.lit("pass"))
    )


def metadata_text(fields: dict[str, Column], separator: str = "; ") -> Column:
    """Labelled concatenation of cleaned fields, blanks left out."""

    def clean(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?i)^File:", ""), r"(?i)\.(jpe?g|png|gif|tiff?|webp)$", "")
        return F.trim(F.regexp_replace(F.translate(bare, "_-", "  "), r"\s+", " "))

    return F.concat_ws(separator, *(F.when(clean(c) != "", F.concat(F.lit(f"{label}: "), clean(c))) for label, c in fields.items()))


def dates_in(text: Column) -> Column:
    """Distinct valid (y, m, d) written year first with -, / or ., between 1900 and 2099."""
    found = F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2})"), F.lit(1))
    parts = F.transform(found, lambda d: F.transform(F.split(d, "[-/.]"), lambda x: x.cast("int")))
    valid = F.filter(parts, lambda p: F.try_to_date(F.concat_ws("-", F.get(p, 0), F.lpad(F.get(p, 1).cast("string"), 2, "0"), F.lpad(F.get(p, 2).cast("string"), 2, "0")), "yyyy-MM-dd").isNotNull())
    return F.array_distinct(F.transform(valid, lambda p: F.struct(F.get(p, 0).alias("y"), F.get(p, 1).alias("m"), F.get(p, 2).alias("d"))))


PHRASES_BLOCK = 50_000  # phrases that one automaton holds


def with_phrases(pages: DataFrame, text: str, phrases: DataFrame, out: str = "phrases") -> DataFrame:
    """``pages`` and, as array ``out``, the distinct ``phrases`` (one column) that the text contains, in order of the alphabet.

    Phrases are a stated set: blocks of ``PHRASES_BLOCK`` become one automaton
    each, which finds all of a block's phrases in one pass over a text, however
    many they are; every further block is a further pass over the pages. No page
    is compared with a phrase it does not hold. A null phrase or text holds
    nothing, an empty phrase is in every text.
    """
    name = phrases.columns[0]
    listed = sorted(r[0] for r in phrases.where(F.col(name).isNotNull()).distinct().collect())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    found = pages.withColumn(out, F.array().cast("array<string>"))
    for a in range(0, len(listed), PHRASES_BLOCK):
        found = found.mapInPandas(_search(listed[a : a + PHRASES_BLOCK], text, out), f"{fields}, `{out}` array<string>")
    return found


def _search(block: list[str], text: str, out: str):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, phrase in enumerate(block):
            if phrase:
                machine.add_word(phrase, i)
        machine.make_automaton()
        always = [i for i, phrase in enumerate(block) if not phrase]

        def held(value: str | None, before) -> list[str]:
            if value is None:
                return list(before)
            hits = {i for _, i in machine.iter(value)} if len(machine) else set()
            return [*before, *(block[i] for i in sorted(hits.union(always)))]

        for frame in frames:
            yield frame.assign(**{out: [held(v, b) for v, b in zip(frame[text], frame[out], strict=True)]})

    return search


def phrase_pages(pages: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(query, item)`` for pages that contain every phrase of a query (relational division).

    ``pages`` (item, text) are searched for all phrases at once; what they hold
    meets the queries (query, phrase) by equality.
    """
    asked = phrases.where(F.col("phrase").isNotNull()).select("query", "phrase").distinct()
    need = asked.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    held = with_phrases(pages.select("item", "text"), "text", asked.select("phrase")).select("item", F.explode("phrases").alias("phrase")).distinct()
    met = held.join(asked, "phrase").groupBy("query", "item").agg(F.count(F.lit(1)).alias("n"))
    return met.join(need, "query").where("n = need").select("query", "item")


def suggested_category(text: Column) -> Column:
    """Category that words of identity papers suggest; empty if none."""
    return F.when(F.regexp_replace(text, r"\s+", " ").rlike(IDENTITY_WORDS), F.lit(IDENTITY_CATEGORY)).otherwise("")


def category_checked(route: Column, current: Column, suggested: Column) -> Column:
    """Passing pages whose text suggests another category go to review."""
    return F.when((route == "pass") & (suggested != "") & (suggested != current), F.lit("category_review")).otherwise(route)
