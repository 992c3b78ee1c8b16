"""Removal of word passages that an earlier document holds: fixed blocks, rolling probes, extended hits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import WordHashes, mixed
from tessera.sources.workspace import discard, materialize

GRAM = 8  # words of the gram a block is looked up by
EMPTY = hashlib.sha256(b"").hexdigest()
_LEFT, _RIGHT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)


def window_hashes(words: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes, put together from windows of powers of two; ``kind`` 0 and 1 are independent."""
    left, right = np.uint64(_LEFT[kind]), np.uint64(_RIGHT[kind])
    power, span, out, at = words, 1, None, 0
    while True:
        if size & span:
            n = len(words) - at - span + 1
            part = power[at : at + max(n, 0)]
            out = mixed(part + left) if out is None else mixed(out[: len(part)] * left + part * right + np.uint64(at))
            at += span
        if at == size:
            return out
        power = mixed(power[:-span] * left + power[span:] * right + np.uint64(span)) if len(power) > span else power[:0]
        span *= 2


def rolling_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` consecutive values."""
    span = 1
    while 2 * span <= size and len(values) > span:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest < len(values) else values[:0]


def block_keys(words: np.ndarray, block: int) -> np.ndarray:
    """What each window of ``block`` words is looked up by: the least hash among its grams, which neighbouring windows mostly share."""
    gram = min(GRAM, block)
    return rolling_least(window_hashes(words, gram), block - gram + 1)


def _pages(block: int):
    def read(frames):
        words = WordHashes()
        for rows in frames:
            out = {"n_words": [], "first": [], "second": [], "whole": [], "keys": [], "n_blocks": []}
            for text in rows["text"]:
                found = text.split()
                h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
                joined = b" ".join(found)
                same = xxhash.xxh3_128_intdigest(joined)
                keys = block_keys(h, block).view(np.int64)
                own = np.unique(keys[::block])
                out["n_words"].append(len(found))
                out["first"].append(np.uint64(same >> 64).view(np.int64))
                out["second"].append(np.uint64(same & (2**64 - 1)).view(np.int64))
                out["whole"].append(hashlib.sha256(joined).hexdigest())
                out["keys"].append(np.concatenate([own, np.setdiff1d(keys, own)]))
                out["n_blocks"].append(len(own))
            yield rows.assign(**out)

    return read


def _extended(length: int, block: int):
    """Hashes of all windows of ``length`` words round a hit."""

    def extend(frames):
        words = WordHashes()
        for rows in frames:
            for row, rank, text, live in zip(rows["row"], rows["rank"], rows["text"], rows["keys"], strict=True):
                found = text.split()
                h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
                hit = np.isin(block_keys(h, block).view(np.int64), live)
                # A window from i on holds the blocks from i to i + length - block.
                seen = np.concatenate([[0], np.cumsum(hit)])
                n = len(h) - length + 1
                if n > 0:
                    at = np.flatnonzero(seen[length - block + 1 : length - block + 1 + n] > seen[:n])
                    a, b = (window_hashes(h, length, k)[at].view(np.int64) for k in (0, 1))
                    yield pd.DataFrame({"first": a, "second": b, "row": row, "rank": rank, "at": at.astype(np.int64)})

    return extend


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of words that windows of ``length`` words from ``starts`` on cover."""
    starts = np.unique(starts)
    new = np.flatnonzero(np.diff(starts) > length) + 1
    firsts, lasts = np.concatenate([starts[:1], starts[new]]), np.concatenate([starts[new - 1], starts[-1:]])
    return [(int(a), int(b) + length) for a, b in zip(firsts, lasts, strict=True)]


def _cut(length: int, digest: bool):
    def cut(frames):
        for rows in frames:
            spans, kept = [], []
            for text, starts in zip(rows["text"], rows["starts"], strict=True):
                found = text.split()
                gone = [] if starts is None else spans_of(starts, length)
                for a, b in reversed(gone):
                    del found[a:b]
                joined = b" ".join(found)
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace"))
            yield pd.DataFrame({"row": rows["row"], "spans": spans, "kept": kept})

    return cut


def remove_passages(documents: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, spans`` and ``kept_text`` (or ``kept_sha256``).

    A word goes if a window of ``length`` words that covers it also starts in
    a document with a smaller id; windows are judged on the input. ``spans``
    are the maximal runs of removed words (start, end exclusive), the kept
    words are joined by one space. Words are runs of characters other than
    blank and \\t-\\r.

    Documents are cut into non-overlapping blocks of half a window, so every
    window holds a whole block of any document that it occurs in. Blocks are
    indexed, and every rolling window of a block's length is looked up, by
    the least hash of their grams of eight words; a document sends each such
    key once. A key is live if a block of one document is met by a window of
    a later, different one. Only round live keys are hits extended: every
    window of ``length`` words there is hashed (128 bits), the smallest
    document of each hash found by an aggregate, and neighbouring windows
    merge into maximal repeats. No pair of documents is ever built, so a
    passage shared by m documents costs m rows.

    Documents of equal words are collapsed first: of those, the smallest id is
    looked at, later ones lose every word if they have ``length`` of them.
    Null and empty texts have no words. A null id comes after all others;
    rows of equal id (or none) take nothing from each other. Other columns are
    not read. Long texts are handled whole, one in memory at a time.
    """
    if length < 2:
        raise ValueError("a passage has two words at least")
    block = (length + 1) // 2
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("rank"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pages = rows.mapInPandas(_pages(block), f"row long, doc_id {kind}, rank long, text binary, n_words long, first long, second long, whole string, keys array<long>, n_blocks int")
    pages = materialize(pages, "pages")

    same = pages.groupBy("first", "second").agg(F.min("rank").alias("lowest"), F.max("rank").alias("highest")).where("lowest < highest")
    same = materialize(same.select("first", "second", "lowest"), "equal-pages")
    light = pages.select("row", "doc_id", "rank", "n_words", "first", "second", "whole").join(same, ["first", "second"], "left")
    light = materialize(light.select("row", "doc_id", "n_words", "whole", F.coalesce(F.col("lowest") < F.col("rank"), F.lit(False)).alias("copy")), "light-pages")
    discard(same)

    each = pages.select("row", "rank", "first", "n_blocks", F.posexplode("keys").alias("place", "key"))
    found = each.groupBy("key").agg(
        F.min(F.when(F.col("place") < F.col("n_blocks"), F.col("rank"))).alias("block"), F.max("rank").alias("probe"), F.min("first").alias("low"), F.max("first").alias("high")
    )
    live = materialize(found.where("block < probe and low != high").select("key"), "live-keys")
    hits = each.select("row", "key").join(live, "key").groupBy("row").agg(F.collect_list("key").alias("keys"))
    hits = hits.join(light.where("not copy").select("row"), "row")
    near = materialize(pages.select("row", "rank", "text").join(hits, "row"), "hit-pages")
    windows = materialize(near.mapInPandas(_extended(length, block), "first long, second long, row long, rank long, at long"), "windows")
    discard(live, *[pages] * digest)
    held = windows.groupBy("first", "second").agg(F.min("rank").alias("lowest"), F.max("rank").alias("highest")).where("lowest < highest")
    held = materialize(held.select("first", "second", "lowest"), "repeated-windows")
    starts = windows.join(held, ["first", "second"]).where("rank > lowest").groupBy("row").agg(F.collect_list("at").alias("starts"))
    starts = materialize(starts, "repeat-starts")
    discard(windows, held)

    # A digest of an untouched text is known already; texts themselves are read again.
    texts = near.select("row", "text") if digest else pages.select("row", "text")
    cut = texts.join(starts, "row", "inner" if digest else "left").mapInPandas(_cut(length, digest), "row long, spans array<struct<start: long, end: long>>, kept string")
    met = light.join(cut, "row", "left")
    gone = F.col("copy") & (F.col("n_words") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    met = met.withColumn("spans", F.when(gone, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.when(gone, F.lit(EMPTY if digest else "")).otherwise(F.coalesce("kept", "whole") if digest else F.col("kept"))
    return met.select("doc_id", "n_words", removed.alias("n_removed"), "spans", kept.alias("kept_sha256" if digest else "kept_text"))
