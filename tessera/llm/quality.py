"""Document quality rules as a short-circuit cascade, in built-in functions only.

A verdict evaluates the rules one after the other and stops at the first that
rejects, and a rule computes its measures only when its turn comes. The order
is taken from a bounded sample drawn by a hash over the whole table, on which
each rule's running time and share of rejected texts are measured: most
rejection per cost first. The order changes what is computed, never the
verdict, which is "no rule rejects".
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.workspace import materialize

BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def window_hashes(words: Column, width: int = 3) -> Column:
    """Hash of every ``width``-word window, in order; empty for shorter texts."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(width)), lambda i: F.xxhash64(*(F.get(words, i + F.lit(j)) for j in range(width))))
    return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column, width: int = 3) -> Column:
    """Words inside a window whose hash occurs twice or more.

    Sorting (hash, place) puts equal windows side by side, so the work is
    n log n for any text; texts without a repeat stop at the distinct count.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, k + F.lit(d))["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - F.lit(1)), lambda k: same(k, -1) | same(k, 1))
        return F.sort_array(F.transform(at, lambda k: F.get(pairs, k)["i"]))

    def total(starts: Column) -> Column:
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    # A one-element array binds the sorted pairs to a name, so they are built once.
    counted = F.get(F.transform(F.array(ordered), lambda pairs: total(repeated(pairs))), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(counted)


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def measured(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures that are reported for every text; null texts count as empty.

    ``_text`` and ``_lines`` stay beside them for rules that need more.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = documents.withColumns({"_text": text}).withColumns({"_words": words_of(F.col("_text")), "_lines": lines_of(F.col("_text"))})
    second = first.withColumn("_windows", window_hashes(F.col("_words")))
    return second.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered_words(F.col("_windows")).cast("long"),
        }
    ).drop("_words", "_windows")


@dataclass(frozen=True)
class Rule:
    """Rejects a text; ``test`` gets a getter for measures, by name."""

    name: str
    test: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: F.lit(100) * m("n_repeat_words") > F.lit(50) * m("n_words")),
    Rule("symbols", lambda m: F.lit(10) * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: F.lit(2) * m("n_dup_lines") > m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < F.lit(2) * m("n_words")) | (m("word_chars") > F.lit(15) * m("n_words"))),
    Rule("upper_case", lambda m: F.lit(2) * m("n_upper") > m("word_chars")),
)


BASE_RULES = ("few_words", "repeated_windows")


def from_text(text: Column) -> Callable[[str], Column]:
    """Measures computed on demand from the text, so that a rule pays only for its own."""
    words = words_of(text)
    lines = lines_of(text)
    made = {
        "n_words": lambda: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
        "word_chars": lambda: F.length(F.regexp_replace(text, BLANK, "")),
        "n_symbols": lambda: F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_lines": lambda: F.size(lines),
        "n_dup_lines": lambda: F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": lambda: F.get(
            F.transform(F.array(words), lambda w: F.get(F.transform(F.array(window_hashes(w)), lambda h: covered_words(h)), F.lit(0))), F.lit(0)
        ),
        "n_upper": lambda: F.regexp_count(text, F.lit(r"\p{Lu}")),
    }
    return lambda name: made[name]()


def rule_sample(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 500, longest: int = 65_536) -> DataFrame:
    """About ``rows`` texts of at most ``longest`` bytes each, written as a working table.

    Rows are drawn by a hash of id and length over the whole table, so the
    sample depends neither on order nor on partitioning. It serves to rate
    rules only; no verdict depends on it.
    """
    total = documents.count()
    share = min(1.0, 1.3 * rows / total) if total else 1.0
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.length(text)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)
    drawn = documents.where(draw).select(text.alias("text")).where(F.octet_length("text") <= longest).limit(2 * rows)
    return materialize(drawn.coalesce(1), "rule-sample")


def ordered_rules(sample: DataFrame, rules: tuple[Rule, ...] = (), *, repeat: int = 4) -> list[Rule]:
    """``rules`` by rejections per second on a table of sample texts.

    Each rule runs over every sample text ``repeat`` times; what a job without
    any rule takes is subtracted, so its time is the rule's own. An empty
    table, or one where no rule rejects, keeps the given order among equals.
    """
    rules = rules or RULES
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).withColumn("text", F.concat("text", F.repeat(F.lit(" "), F.col("again"))))

    def seconds(test: Column) -> tuple[float, float]:
        job = again.agg(F.avg(test.cast("double")).alias("share"), F.sum(F.length("text")))
        began = time.perf_counter()
        share = job.first()["share"] or 0.0
        return share, time.perf_counter() - began

    seconds(F.lit(False))  # opens the table and compiles what all jobs share
    idle = min(seconds(F.lit(False))[1] for _ in range(2))
    rated = []
    for place, rule in enumerate(rules):
        share, spent = seconds(rule.test(from_text(F.col("text"))))
        rated.append((-share / max(spent - idle, 1e-3), place, rule))
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def first_rejection(rules: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, null if none; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.test(measure), F.lit(rule.name)).otherwise(out)
    return out


def quality_report(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, measures, ``base_failed``, ``rejected_by`` and ``kept``.

    The base rules decide first; texts they let pass go through the cascade of
    the other rules, in rated order, which take the reported measures as they
    are and compute the rest from the text when their turn comes. Texts of any
    length are measured whole. Null and empty texts have no words and are
    rejected; a null id and repeated rows pass through as they are; other
    columns are not read.
    """
    own = tuple(r for r in RULES if r.name not in BASE_RULES)
    order = ordered_rules(rule_sample(documents, id_col=id_col, text_col=text_col), own)
    rows = measured(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = [r for r in RULES if r.name in BASE_RULES]
    told = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = rows.withColumn("base_failed", base[0].test(F.col) | base[1].test(F.col))
    lazy = from_text(F.col("_text"))
    more = {"n_lines": lambda: F.size("_lines")}
    measure = lambda name: F.col(name) if name in told else more[name]() if name in more else lazy(name)
    rejected = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rejection(order, measure))
    return rows.select("doc_id", *told, "base_failed", rejected.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def quality_filter(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns; nulls, ties and long texts as in ``quality_report``."""
    order = ordered_rules(rule_sample(documents, id_col=id_col, text_col=text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.where(first_rejection(order, from_text(text)).isNull())
