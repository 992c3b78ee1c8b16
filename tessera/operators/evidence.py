"""What the lines of a page say to literal conditions.

A page is turned once into facts: its normal text, its lines without blanks,
the dates, long numbers and Latin words on it. A condition is a test of its
kind on these facts, written as a Column expression over the array of
conditions. Two helpers in Python give what Spark has no function for: like
words with their similarity, and the similarity of a term with a whole page.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.text import bound, computed_once
from tessera.operators.conditions import CN_DATE, MONTHS, PHONE, SHORT_MONTHS, PageText, literal_conditions, normal, override_eligibility

FORMS = "array<array<string>>"
LIKE = "map<string,map<string,double>>"

# Dates as pages write them, by the places of year, month and day.
MONTH_NAMES = "|".join(MONTHS + SHORT_MONTHS)
YMD = r"(?<!\d)(?:19|20)\d{2}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}(?:\s*日)?(?!\d)"
MDY = r"(?<!\d)\d{1,2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*(?:\d{2}|(?:19|20)\d{2})(?!\d)"
WORDED = rf"(?i)\b(?:{MONTH_NAMES})\s*[-/.]?\s*\d{{1,2}}(?:st|nd|rd|th)?\s*[,./-]?\s*(?:(?:19|20)?\d{{2}})\b"


def normal_forms(values: Column) -> Column:
    """Normal forms of arrays of texts."""

    @pandas_udf(FORMS)
    def formed(lists: pd.Series) -> pd.Series:
        return lists.map(lambda rows: [[normal(str(v)) for v in row if v is not None] if row is not None else [] for row in rows] if rows is not None else None)

    return formed(values)


def like_words(wanted: Column, words: Column, least: float) -> Column:
    """For each wanted word the page's words that are like it, with their similarity, where that is ``least`` or more."""

    @pandas_udf(LIKE)
    def found(asked: pd.Series, pages: pd.Series) -> pd.Series:
        def one(ts, ws):
            out = {t: {} for t in (ts if ts is not None else ())}
            for w in set(ws if ws is not None else ()):
                for t, held in out.items():
                    if t == w:
                        held[w] = 1.0
                    elif 2 * min(len(t), len(w)) >= least * (len(t) + len(w)):
                        m = SequenceMatcher(None, t, w)
                        if m.quick_ratio() >= least and m.ratio() >= least:
                            held[w] = round(m.ratio(), 8)
            return out

        return pd.Series([one(t, w) for t, w in zip(asked, pages, strict=True)])

    return found(wanted, words)


def page_similarity(terms: Column, lines: Column, least: float) -> Column:
    """For each list of terms the similarities of its terms with the page; 0 where none reaches ``least``."""

    @pandas_udf("array<array<double>>")
    def rated(asked: pd.Series, pages: pd.Series) -> pd.Series:
        def one(lists, page):
            text = PageText([str(x) for x in page if x is not None] if page is not None else [])
            best = lambda t: round(text.best_ratio(t, least), 8) if normal(t) else 0.0
            return [[b if (b := best(t)) >= least else 0.0 for t in ts] for ts in (lists if lists is not None else ())]

        return pd.Series([one(t, p) for t, p in zip(asked, pages, strict=True)])

    return rated(terms, lines)


def dates_on(text: Column) -> Column:
    """Valid dates of 1900 to 2099 in a text, in numbers or with a month's name; years of two digits are 1950 to 2049."""
    number = lambda x, n: F.regexp_extract(x, r"(\d+)" + r"\D+(\d+)" * (n - 1), n)
    year = lambda y: F.when(F.char_length(y) > 2, y).otherwise(F.concat(F.when(y >= "50", "19").otherwise("20"), y))
    month = lambda x: F.ceil((F.position(F.lower(F.substring(x, 1, 3)), F.lit("".join(m.lower() for m in SHORT_MONTHS))) + 2) / 3).cast("string")
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    listed = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = F.concat(
        F.transform(listed(YMD), lambda x: made(number(x, 1), number(x, 2), number(x, 3))),
        F.transform(listed(MDY), lambda x: made(year(number(x, 3)), number(x, 1), number(x, 2))),
        # A year of two digits may stand right behind the day: "May 1,99" has two numbers, "May 199" none that part.
        F.transform(listed(WORDED), lambda x: made(year(F.regexp_extract(x, r"((?:19|20)?\d{2})$", 1)), month(x), F.regexp_extract(x, r"(\d{1,2})(?:st|nd|rd|th|ST|ND|RD|TH)?\s*[,./-]?\s*(?:19|20)?\d{2}$", 1))),
    )
    return F.filter(every, lambda d: d.between("1900-01-01", "2099-12-31"))


def latin_words(text: Column) -> Column:
    """ASCII words in order; two Greek letters are spelled out, words broken at a line's end joined."""
    low = F.replace(F.replace(F.lower(F.regexp_replace(text, r"-\s+", "")), F.lit("α"), F.lit("alpha")), F.lit("β"), F.lit("beta"))
    return F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))


def with_page_facts(pages: DataFrame, lines: str) -> DataFrame:
    """Adds the facts of a page: ``_text, _normal, _tight`` (lines without blanks), ``_dates, _numbers, _words``."""
    held = F.filter(F.coalesce(F.col(lines), F.array().cast("array<string>")), lambda x: x.isNotNull())
    rows = pages.withColumn("_text", F.array_join(held, " ")).withColumn("_forms", normal_forms(F.array(held, F.array("_text"))))
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    numbers = F.flatten(F.transform(held, lambda x: F.regexp_extract_all(x, F.lit(PHONE), F.lit(0))))
    facts = {
        "_normal": F.get(F.get("_forms", F.lit(1)), F.lit(0)), "_tight": F.transform(F.get("_forms", F.lit(0)), tight), "_dates": dates_on(F.col("_text")),
        "_numbers": F.filter(F.transform(numbers, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: F.char_length(x) >= 7), "_words": latin_words(F.col("_text")),
    }
    return rows.withColumns(facts).drop("_forms")


FACTS = ("_text", "_normal", "_tight", "_dates", "_numbers", "_words")
MATCHED = "struct<matched:boolean,best_variant:string,match_level:string,similarity:double>"


def with_evidence(rows: DataFrame, *, conditions: str = "conditions", lines: str = "lines", level: str = "explicit", fuzzy: float = 0.88, out: str = "evidence") -> DataFrame:
    """Adds ``out``: ``n_conditions, n_matched, complete, evidence`` of each row's conditions on its lines.

    ``evidence`` holds label, source, whether it matched, by which variant, how
    and how nearly (0 if nothing is near enough). A page is complete if it
    meets every condition and there is one. Kinds of test: dates, identifiers
    and phone ends are looked up among the page's facts; quoted values stand in
    its normal text; Latin phrases need every word (words of six letters or
    more may differ a little), bound terms need them side by side; all else
    stands there as it is or nearly (kinds in ``structured_`` as it is only).
    Below the ``structured`` level only phone ends have a test of their own.
    Null lines are an empty page, null conditions are none.
    """
    near = min(fuzzy, 0.85)
    special = [] if level == "basic" else ["structured_date", "structured_identifier", "latin_phrase", "bound_latin_term", *(["explicit_required"] if level == "explicit" else [])]
    special.append("phone_suffix")
    asked = F.coalesce(F.col(conditions), F.array().cast("array<struct<label:string,variants:array<string>,source:string>>"))
    found = with_page_facts(rows, lines).withColumn("_asked", asked)
    found = found.withColumn("_forms", normal_forms(F.transform("_asked", lambda c: c["variants"])))
    # Only kinds that may be met nearly are compared with the whole page, only Latin kinds with its words.
    loose = lambda c: ~c["source"].isin(*special) & ~F.startswith(c["source"], F.lit("structured_"))
    none = F.array().cast("array<string>")
    found = found.withColumn("_near", page_similarity(F.transform("_asked", lambda c: F.when(loose(c), c["variants"]).otherwise(none)), F.col(lines), fuzzy))
    latin = F.filter("_asked", lambda c: c["source"].isin("latin_phrase", "bound_latin_term"))
    wanted = F.array_distinct(F.flatten(F.transform(latin, lambda c: F.flatten(F.transform(c["variants"], latin_words)))))
    found = found.withColumn("_like", like_words(wanted, F.col("_words"), near))

    said = lambda ok, variant, how, similarity: F.struct(ok.alias("matched"), variant.alias("best_variant"), F.when(ok, how).otherwise("none").alias("match_level"), F.when(ok, similarity).otherwise(0.0).alias("similarity")).cast(MATCHED)
    need = lambda t, six: F.when(F.char_length(t) <= 5, 1.0).when(F.char_length(t) >= 7, near).otherwise(six)
    like = lambda t, six: F.map_filter(F.coalesce(F.element_at(F.col("_like"), t), F.create_map().cast("map<string,double>")), lambda w, r: r >= need(t, six))
    most = lambda t, six: F.coalesce(F.array_max(F.map_values(like(t, six))), F.lit(0.0))

    def by_variant(c: Column, test) -> Column:
        """The best of the condition's variants: matched ones first, then the more similar, then the earlier."""
        rated = F.transform(c["variants"], lambda v, i: F.struct(test(v, i).alias("e"), (-i).alias("at")))
        best = F.array_max(F.transform(rated, lambda r: F.struct(r["e"]["matched"].alias("m"), (r["e"]["match_level"] == "exact").alias("x"), r["e"]["similarity"].alias("s"), r["at"].alias("at"), r["e"].alias("e"))))
        return F.coalesce(best["e"], said(F.lit(False), F.lit(None).cast("string"), F.lit("none"), F.lit(0.0)))

    def phrase(v: Column, i: Column) -> Column:
        return bound(latin_words(v), lambda ts: said((F.size(ts) > 0) & F.forall(ts, lambda t: most(t, fuzzy) > 0), v, F.lit("token_coverage"), F.array_min(F.transform(ts, lambda t: most(t, fuzzy)))))

    def side_by_side(v: Column, i: Column) -> Column:
        def placed(ts: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - F.size(ts), F.lit(0)))
            rating = lambda s: F.array_min(F.transform(ts, lambda t, k: F.coalesce(F.element_at(like(t, near), F.get("_words", s + k)), F.lit(0.0))))
            best = F.coalesce(F.array_max(F.filter(F.transform(starts, rating), lambda r: r > 0)), F.lit(0.0))
            return bound(best, lambda b: said((F.size(ts) > 0) & (b > 0), v, F.lit("bound_token_sequence"), b))

        return bound(latin_words(v), placed)

    def test(c: Column, n: Column) -> Column:
        form = F.coalesce(F.get(F.get("_forms", n), F.lit(0)), F.lit(""))
        tight = F.replace(form, F.lit(" "), F.lit(""))
        first = F.get(c["variants"], F.lit(0))
        line = F.exists("_tight", lambda x: (x == tight) | ((F.char_length(tight) >= 4) & F.contains(x, tight)))
        date = F.try_to_date(F.regexp_replace(c["label"], f"^{CN_DATE}$", "$1-$2-$3"), "y-M-d")
        whole = F.replace(F.col("_normal"), F.lit(" "), F.lit(""))

        def plain(v: Column, i: Column) -> Column:
            f = F.coalesce(F.get(F.get("_forms", n), i), F.lit(""))
            exact = (f != "") & (F.contains(F.col("_normal"), f) | F.contains(whole, F.replace(f, F.lit(" "), F.lit(""))))
            nearly = F.coalesce(F.get(F.get("_near", n), i), F.lit(0.0))
            return said(exact | (nearly > 0), v, F.when(exact, "exact").otherwise("fuzzy"), F.when(exact, 1.0).otherwise(nearly))

        one, source = F.lit(1.0), c["source"]
        kinds = {
            "phone_suffix": said(F.exists("_numbers", lambda x: F.endswith(x, first)), first, F.lit("exact"), one),
            "structured_date": said(F.coalesce(F.array_contains("_dates", date), F.lit(False)), c["label"], F.lit("structured_exact"), one),
            "structured_identifier": said((tight != "") & line, first, F.lit("structured_exact"), one),
            "explicit_required": said((form != "") & F.contains(F.col("_normal"), form), first, F.lit("exact"), one),
            "latin_phrase": by_variant(c, phrase),
            "bound_latin_term": by_variant(F.struct(F.slice(c["variants"], 1, 1).alias("variants")), side_by_side),
        }
        chosen = None
        for name in special:
            chosen = (F if chosen is None else chosen).when(source == name, kinds[name])
        return chosen.otherwise(by_variant(c, plain))

    told = lambda c, e: F.struct(c["label"].alias("label"), c["source"].alias("source"), *(e[f].alias(f) for f in ("matched", "best_variant", "match_level", "similarity")))
    found = found.withColumn("_evidence", computed_once(F.transform("_asked", lambda c, n: bound(test(c, n), lambda e: told(c, e)))))
    n = F.size("_asked")
    matched = F.size(F.filter("_evidence", lambda e: e["matched"]))
    made = F.struct(n.alias("n_conditions"), matched.alias("n_matched"), ((n > 0) & (n == matched)).alias("complete"), F.col("_evidence").alias("evidence"))
    return found.withColumn(out, made).drop(*FACTS, "_asked", "_forms", "_near", "_like", "_evidence")


def select_literal(candidates: DataFrame, *, level: str = "explicit", fuzzy: float = 0.88, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Per query of rows (query_id, query, item, rank, lines): the first candidate that meets every condition.

    ``(query_id, item, rank, accepted)``; queries that are not eligible, or
    have no complete candidate, have no item. The first level asks for no
    eligibility. Conditions are read once per distinct query.
    """
    asked = candidates.select(query_id, query).distinct().withColumn("conditions", literal_conditions(F.col(query), level))
    asked = override_eligibility(asked, query, level).withColumn("eligible", F.lit(True) if level == "basic" else F.col("eligibility.eligible"))
    rows = candidates.drop(query).join(asked.select(query_id, "conditions", "eligible"), query_id).where("eligible")
    met = with_evidence(rows, level=level, fuzzy=fuzzy).where("evidence.complete")
    first = met.groupBy(query_id).agg(F.min(F.struct("rank", "item")).alias("first"))
    return asked.select(query_id).join(first, query_id, "left").select(
        query_id, F.col("first.item").alias("item"), F.col("first.rank").alias("rank"), F.col("first").isNotNull().alias("accepted")
    )
