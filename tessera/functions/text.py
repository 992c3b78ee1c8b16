"""Text expressions: tokens, normal forms, quoted terms, excerpts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What counts as a token run.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
TOKEN_RUN = rf"[{CJK}]+|[a-zA-Z0-9]+(?:[._:/+-][a-zA-Z0-9]+)*"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed_once(value: Column) -> Column:
    """``value`` behind a test that Spark takes for random: it is not copied into the filters and columns above it."""
    return F.when(F.rand(0) >= 0, value)


def token_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RUN), F.lit(0))


def char_ngrams(text: Column, n: int) -> Column:
    """All ``n``-character substrings in order."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - F.lit(n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.char_length(text) >= n, grams).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Mixed-script tokens: a CJK run gives its characters and then its bigrams, any other run is one token."""
    runs = token_runs(text)
    split = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), F.concat(char_ngrams(r, 1), char_ngrams(r, 2))).otherwise(F.array(r))))
    return F.when(text.rlike(f"[{CJK}]"), split).otherwise(runs)


def token_count(text: Column) -> Column:
    """Number of tokens, without listing them where all runs are single tokens."""
    return F.when(text.rlike(f"[{CJK}]"), F.size(tokens(text))).otherwise(F.regexp_count(F.lower(text), F.lit(TOKEN_RUN)))


def normalized_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def compact_ascii(text: Column) -> Column:
    """Lower-case letters and digits only, for text known to be ASCII."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


@pandas_udf(StringType())
def normalized_ocr(values: pd.Series) -> pd.Series:
    """Compatibility composition, case folding, non-word characters to single blanks."""
    import re
    import unicodedata

    other = re.compile(r"\W+")
    return values.map(lambda x: None if x is None else other.sub(" ", unicodedata.normalize("NFKC", x).casefold()).strip())


def compatible(text: Column, fold: bool = True) -> Column:
    """Compatibility composition (NFKC), with case folding if asked for."""

    @pandas_udf(StringType())
    def composed(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold() if fold else unicodedata.normalize("NFKC", x).strip())

    return composed(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def html_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def quoted_terms(query: Column, least: int = 2) -> Column:
    """Terms in straight or curly double quotes, in order of appearance, distinct."""
    found = F.regexp_extract_all(query, F.lit('"[^"]+"|“[^”]+”'), F.lit(0))
    inside = F.transform(found, lambda x: F.trim(F.substring(x, F.lit(2), F.char_length(x) - 2)))
    return F.array_distinct(F.filter(inside, lambda t: F.char_length(t) >= least))


def id_list(value: Column) -> Column:
    """A ``;``- or ``,``-separated list: trimmed, without blanks, distinct, in order."""
    parts = F.transform(F.split(F.replace(value, F.lit(","), F.lit(";")), ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def sparse_weight(query: Column) -> Column:
    """Weight of lexical evidence by compact query length."""
    n = F.char_length(F.array_join(token_runs(query), ""))
    return F.when(n <= 2, 0.05).when(n <= 6, 0.15).otherwise(0.30)


def excerpt(text: Column, terms: Column, width: int = 180, low: Column | None = None) -> Column:
    """At most ``width`` characters around the earliest term, with dots where text is cut.

    ``low`` is the text in lower case, where it is at hand already.
    """
    low = F.lower(text) if low is None else low
    places = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), low)), lambda p: p > 0)
    first = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - F.lit(width // 4))

    def cut(start: Column) -> Column:
        head = F.when(start > 1, F.lit("...")).otherwise("")
        tail = F.when(start + F.lit(width) <= F.char_length(text), F.lit("...")).otherwise("")
        return F.concat(head, F.substring(text, start, F.lit(width)), tail)

    return bound(first, cut)


def edge_trimmed(text: Column) -> Column:
    """White space collapsed, punctuation at both ends removed."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[\s.,;:!?'\"()\[\]-]+|[\s.,;:!?'\"()\[\]-]+$", "")
