"""Lines, phrases and dates that can stand as evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private words, and what names a place or an address.
PRIVATE = r"(?i)地址|住址|电话|手机|邮箱|邮件|身份证|证件号码|出生日期|姓名|学号|账号|银行卡|邮编|微信|\baddress\b|\btelephone\b|\bphone\b|\be-?mail\b|\bpassport\b|\bdate of birth\b"
PLACE = (
    r"(?i)https?://|www\.|\.com\b|\.cn\b|省.{0,12}市|市.{0,12}(?:区|县|镇|路|街|号)|\d+\s+(?:avenue|street|road|boulevard)|"
    r"\bWashington,\s*D\.?C\.?\b|\bN\.?W\.?\b|\b\d{5}(?:-\d{4})?\b"
)


def valid_evidence_line(text: Column, confidence: Column) -> Column:
    """Whether a line can stand as evidence: readable, short, mostly letters, nothing private, no place."""
    n = F.char_length(text)
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    digits = F.char_length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    worded = text.rlike(r"[\x{4e00}-\x{9fff}]") | (F.regexp_count(text, F.lit("[A-Za-z]+")) >= 2)
    distinct = F.size(F.array_distinct(F.split(text, "")))
    bad = text.rlike(r"\d{6,}") | text.rlike("@") | text.rlike(PRIVATE) | text.rlike(PLACE)
    return (confidence >= 0.65) & n.between(4, 36) & ~bad & (letters >= 0.65 * n) & (digits <= 0.5 * letters) & worded & (distinct >= 3)


def phrase_candidates(line: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """The line and its word n-grams, distinct, in order."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")

    def grams(n: int) -> Column:
        def gram(i: Column) -> Column:
            return F.array_join(F.slice(words, i, F.lit(n)), " ")

        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(n - 1)), gram)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array(F.trim(line)), *map(grams, sizes)))


def four_digit_year(year: Column) -> Column:
    """Two-digit years from 50 on belong to the last century."""
    return F.when(year >= 100, year).when(year >= 50, year + 1900).otherwise(year + 2000)


def date_forms(day: Column) -> Column:
    """Ways a date is written, one of each normal form: with signs or in figures, year first or last, with a month's name."""
    return F.array_distinct(F.array(*(F.date_format(day, f) for f in ("y年M月d日", "y-M-d", "M/d/y", "M/d/yy", "MMMM d, y", "MMM d, y"))))
