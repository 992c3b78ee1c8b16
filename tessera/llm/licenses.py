"""Licence scan with a positional rare-token index, in built-in functions only.

Licence templates are indexed by their words of highest IDF over the corpus:
each word's postings name a template and the word's place in it. A text looks
up every indexed word it holds, at every place; postings that agree on "place in text minus place in template"
line a template up with the text. A line-up counts once the template's
mandatory phrase stands where the template has it. Fixed phrases of the base
rule are found at every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences of public licence texts and notices (as words), label, and the phrase that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable for any damages"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented as being the original software"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("artistic", "this package is free software you may redistribute it under the terms of the artistic license", "artistic license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights", "dedicated the work to the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by", "this work is licensed under cc by 4 0", "cc by"),
)

#: All words of the templates; which of them are indexed depends on how rare they are.
VOCABULARY = tuple(sorted({w for _, text, _ in TEMPLATES for w in text.split()}))
RARE = 8  # indexed words of a template

# The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def phrase_places(words: Column, phrase: str) -> Column:
    """Every 0-based start of ``phrase`` in ``words``."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == F.lit(parts[0])
        for j, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + F.lit(j)) == F.lit(part))
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(len(parts))), lambda i: F.coalesce(here(i), F.lit(False)))
    rare = F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0])
    return F.when((F.size(words) >= len(parts)) & rare, found).otherwise(F.array().cast("array<int>"))


def word_rarity(documents: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many texts each word of the templates occurs; at most one row a template word reaches the driver."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = documents.select(F.explode(F.array_intersect(words_of(text), _array(VOCABULARY))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: found.get(w, 0) for w in VOCABULARY}


def indexed_words(rarity: dict[str, int], rare: int = RARE) -> list[list[str]]:
    """Of each template the ``rare`` words with the highest IDF; of equally rare ones the longer, then the first in the alphabet."""
    return [sorted(set(text.split()), key=lambda w: (rarity[w], -len(w), w))[:rare] for _, text, _ in TEMPLATES]


def _postings(indexed: list[list[str]]) -> dict[str, list[Column]]:
    """word -> (template, place) of each template that indexes it."""
    by_word: dict[str, list[Column]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        for place, word in enumerate(text.split()):
            if word in indexed[t]:
                by_word.setdefault(word, []).append(F.struct(F.lit(t).alias("t"), F.lit(place).alias("p")))
    return by_word


def _slices(phrases: list[list[str]]) -> Column:
    return F.array(*(_array(p) for p in phrases))


def scan_licenses(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", agree: int = 2, rare: int = RARE) -> DataFrame:
    """One row per input row: counts, base phrase places, labels and score.

    The index holds each template's ``rare`` rarest words over the whole
    table. Every indexed word of a text is looked up, at every place, so a
    text of any length gets the labels of all its notices; a template lines up
    when ``agree`` of its postings give the same offset. ``score``
    is the largest share of a verified template's words that stand in place,
    1 where a base phrase is found, else 0. Null and empty texts have no words
    and no labels; null ids and repeated rows pass through; other columns are
    not read.
    """
    indexed = indexed_words(word_rarity(documents, text_col), rare)
    postings = _postings(indexed)
    known = tuple(sorted(postings))
    lookup = F.create_map(*(x for word, entries in postings.items() for x in (F.lit(word), F.array(*entries))))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", words_of(F.col("_text")).alias("_words"))
    words = F.col("_words")
    rows = rows.withColumns(
        {f"_p{i}": phrase_places(words, phrase) for i, (phrase, _) in enumerate(PHRASES)} | {"_known": F.arrays_overlap(words, _array(known))}
    )
    # Look up: the known words of this text, their places, and where postings put the templates.
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*known), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.withColumn("_hits", F.when(F.col("_known"), places).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    line_ups = F.flatten(
        F.transform("_hits", lambda h: F.transform(F.element_at(lookup, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"))))
    )
    rows = rows.withColumn("_ups", F.sort_array(line_ups))
    # Equal line-ups are neighbours now: keep the first of each that enough postings agree on.
    enough = [min(agree, sum(w in some for w in text.split())) for (_, text, _), some in zip(TEMPLATES, indexed, strict=True)]
    at = lambda k, u: F.coalesce(F.get("_ups", k) == u, F.lit(False))
    agreed = F.filter("_ups", lambda u, k: (u["o"] >= 0) & ~at(k - F.lit(1), u) & at(k + F.get(_array(enough), u["t"]) - F.lit(1), u))
    rows = rows.withColumn("_agreed", agreed)
    must = [phrase.split() for _, _, phrase in TEMPLATES]
    whole = [text.split() for _, text, _ in TEMPLATES]
    start = [_find(words, phrase) for words, phrase in zip(whole, must, strict=True)]
    stands = F.filter(
        "_agreed",
        lambda u: F.slice(words, u["o"] + F.get(_array(start), u["t"]) + F.lit(1), F.size(F.get(_slices(must), u["t"]))) == F.get(_slices(must), u["t"]),
    )
    rows = rows.withColumn("_stands", stands)
    share = lambda u: F.get(
        F.transform(
            F.array(F.get(_slices(whole), u["t"])),
            lambda t: F.size(F.filter(F.transform(t, lambda w, j: F.coalesce(F.get(words, u["o"] + j) == w, F.lit(False))), lambda ok: ok)) / F.size(t),
        ),
        F.lit(0),
    )
    every = F.flatten(F.array(*(F.col(f"_p{i}") for i in range(len(PHRASES)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))))
    labels = F.transform("_stands", lambda u: F.get(_array([label for label, _, _ in TEMPLATES]), u["t"]))
    best = F.coalesce(F.array_max(F.transform("_stands", share)), F.lit(0.0))
    return rows.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, labels)), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).cast("double").alias("score"),
    )


def _find(words: list[str], part: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)
