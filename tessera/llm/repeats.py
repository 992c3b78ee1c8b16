"""Removal of repeated byte strings by prefix-free parsing.

Every byte covered by a ``length``-byte string that also starts earlier in the
corpus (smaller id, or same document and earlier start) is removed.

**Phrases.** A rolling hash runs over ``gram``-byte strings. In each window of
``length`` bytes the smallest hash is a trigger, so equal windows have equal
triggers at equal distance and no gap can be longer than a window. All windows
with the same trigger form a phrase: the text is a sequence of phrases of at
most ``2 * length - gram`` bytes, each overlapping the next by a window less a byte.

**Suffix order of the parse.** Phrases are sorted by trigger, content and
place. As neighbouring phrases overlap by all that a window can reach beyond
one of them, suffixes of the parse need to be told apart by their first phrase
only; equal neighbours in that order are copies of one dictionary phrase, and
all but the first in corpus order start earlier elsewhere as a whole.

**Suffix arrays of the dictionary.** Only dictionary phrases that share a
trigger with a different phrase can hold a window that also stands in another
phrase. Their bytes are dealt out by trigger, and each task builds the suffix
array of its part of the dictionary by prefix tripling, cut off at depth
``length``: suffixes with the same rank begin with the same window.

**Corpus order.** Ranks and places combine: of the suffixes of one rank the
first in corpus order stays, the others are covered. Triggers with more than
``hot`` different phrases (contexts of one passage that very many documents
share) would all meet in one task. Their phrases are cut in two by how many
bytes a window has before the trigger, and the parts are dealt out by the bytes
that all windows of such a part share. Parts of keys that are still crowded are
merged when equal and cut in two again, down to single windows.

Each task marks the copies among its own rows before a shuffle and deals them
out evenly, so a passage that a third of all documents share sends one row per
task to its place in the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workspace import discard, materialize

CHUNK = 1 << 20  # bytes hashed at once

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15 | 5)
_R2 = np.uint64(0xD1B54A32D192ED03 | 5)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(x: np.uint64) -> np.uint64:
    y = int(x)
    for _ in range(6):
        y = y * (2 - int(x) * y) % (1 << 64)
    return np.uint64(y)


class RollingHash:
    """Polynomial prefix sums modulo 2^64 over random byte values; any substring's hash in O(1)."""

    def __init__(self, size: int):
        self.up = [_powers(r, size + 1) for r in (_R, _R2)]
        self.down = [_powers(_inverse(r), size + 1) for r in (_R, _R2)]

    def prefix(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.up[which][: len(data)], out=out[1:])
        return out

    def substrings(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return _stirred((prefix[end] - prefix[start]) * self.down[which][start])

    def every(self, prefix: np.ndarray, width: int, which: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on."""
        x = prefix[width:] - prefix[:-width]
        x *= self.down[which][: len(x)]
        return _stirred(x)


def _stirred(x: np.ndarray) -> np.ndarray:
    """In place, when it can be: low and high bits mixed."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: block-wise running minima from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def phrases(data: np.ndarray, cuts: np.ndarray, hashes: RollingHash, length: int, gram: int):
    """(trigger, content, first window, number of windows) of each phrase.

    ``cuts`` are the starts of the documents in ``data`` and its end; windows
    do not cross them.
    """
    none = np.empty(0, dtype=np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    key = hashes.every(hashes.prefix(data, 0), gram, 0)
    low = np.uint64((1 << 22) - 1)
    low_key = (key & ~low) | np.arange(len(key), dtype=np.uint64)  # leftmost among equal grams
    trigger = (sliding_minimum(low_key, length - gram + 1) & low).astype(np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = trigger[1:] != trigger[:-1]
    new[cuts[:-1][cuts[:-1] < n]] = True
    for end in cuts[1:]:  # windows that would cross the end of a document
        new[max(end - length + 1, 0) : end] = False
    first = np.flatnonzero(new)
    if not len(first):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    # A phrase's windows are consecutive; it ends at the next phrase or where windows leave the document.
    bound = np.append(first[1:], n)
    last_inside = cuts[np.searchsorted(cuts, first, side="right")] - length + 1
    count = np.minimum(bound, last_inside) - first
    two = hashes.prefix(data, 1)
    content = hashes.substrings(two, first, first + count + length - 1, 1) ^ (count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key[trigger[first]], content, first, count


def _pieces(ids: list, texts: Iterator[bytes], length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents gathered into buffers of about CHUNK bytes; longer ones overlap by a window."""
    rows, offsets, parts, size = [], [], [], 0
    step = CHUNK - length + 1
    for i, text in zip(ids, texts, strict=True):
        for a in range(0, max(len(text) - length + 1, 0), step):
            piece = text[a : a + CHUNK]
            if size + len(piece) > 2 * CHUNK:
                yield rows, *_buffer(parts, offsets)
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(a)
            parts.append(piece)
            size += len(piece)
    if parts:
        yield rows, *_buffer(parts, offsets)


def _buffer(parts: list[bytes], offsets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cuts = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), cuts, np.array(offsets, dtype=np.int64)


COPY, FIRST = 1, 0
HELD = 1_000_000  # rows a task holds back to find copies among them


def later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows have both hashes of a row at an earlier place."""
    key = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[inverse] > 1)
    order = some[np.lexsort((at[some], doc[some], h2[some], h1[some]))]
    same = np.zeros(len(order), dtype=bool)
    k1, k2, d, a = h1[order], h2[order], doc[order], at[order]
    same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    # Rows at the very place of the first are that row again, not a later one.
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    same &= (d != d[start]) | (a != a[start])
    out = np.zeros(len(h1), dtype=bool)
    out[order[same]] = True
    return out


class _Rows:
    """Rows (two hashes, document, place, windows, maybe bytes) of a task, given out with copies among them marked."""

    def __init__(self, held: int = HELD):
        self.parts, self.size, self.held = [], 0, held

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.size >= self.held

    def batch(self) -> pa.RecordBatch:
        h1, h2, doc, at, n, *phrase = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        copy = later(h1, h2, doc, at)
        where = np.where(copy, (doc * np.int64(1_000_003) + at) * np.int64(2_654_435_761), h1.view(np.int64))
        columns = [pa.array(c) for c in (where, copy.astype(np.int32), h1.view(np.int64), h2.view(np.int64), doc, at, n.astype(np.int32))]
        columns += [pa.array(np.where(copy, None, p), pa.binary()) for p in phrase]
        return pa.RecordBatch.from_arrays(columns, names=["place_by", "kind", "h1", "h2", "doc_id", "at", "windows", "phrase"][: len(columns)])


PARSED = "place_by long, kind int, h1 long, h2 long, doc_id long, at long, windows int"
FOUND = "kind int, trigger long, doc_id long, at long, windows int"


def _parse(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Phrases of a task's documents: trigger and content hash, place, windows."""
    hashes, rows = RollingHash(2 * CHUNK), _Rows()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = (t.as_py() or b"" for t in batch.column(1).cast(pa.binary()))
        for docs, data, cuts, offsets in _pieces(ids, texts, length):
            trigger, content, first, count = phrases(data, cuts, hashes, length, gram)
            part = np.searchsorted(cuts, first, side="right") - 1
            if len(first) and rows.add(trigger, content, np.array(docs, dtype=np.int64)[part], first - cuts[part] + offsets[part], count):
                yield rows.batch()
    if rows.size:
        yield rows.batch()


def _halves(phrase: list[bytes], places: list[tuple], hashes: RollingHash, length: int, gram: int, width: int) -> tuple:
    """Phrases (bytes; document, place, windows) cut by how many bytes a window has before the trigger, ``width`` such numbers a part.

    Two hashes of each part (of what every window with such a number shares, and of its bytes), its place, windows and bytes.
    """
    data = np.frombuffer(b"".join(phrase), dtype=np.uint8)
    doc, at, n = (np.array(x, dtype=np.int64) for x in zip(*places, strict=True))
    begin = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
    one, two = hashes.prefix(data, 0), hashes.prefix(data, 1)
    span = length - gram + 1
    key = hashes.every(one, gram, 0) & ~np.uint64((1 << 22) - 1)  # the order that ``phrases`` chose triggers by
    trigger = np.argmin(key[begin[:, None] + np.arange(span)], axis=1)
    low, high = (trigger - n + 1) // width, trigger // width
    many = high - low + 1
    of = np.repeat(np.arange(len(n)), many)
    part = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    t, least, most = trigger[of], part * width, np.minimum(part * width + width, span) - 1
    shared = hashes.substrings(one, begin[of] + t - least, begin[of] + t - most + length, 0)
    before, after = np.minimum(t, most), np.maximum(t - n[of] + 1, least)
    first, count = t - before, before - after + 1
    start, end = begin[of] + first, begin[of] + first + count + length - 1
    content = hashes.substrings(two, start, end, 1) ^ (count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cut = np.empty(len(of), dtype=object)
    cut[:] = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return shared, content, doc[of], at[of] + first, count, cut


def _parts(batches: Iterator[pa.RecordBatch], length: int, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """The given phrases (document, place, windows, bytes) in parts, with two hashes of each."""
    hashes, rows, step = RollingHash(CHUNK + 4 * length), _Rows(HELD // 8), CHUNK // (2 * length)
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            doc, at, n, phrase = (batch.column(c)[a : a + step].to_pylist() for c in ("doc_id", "at", "windows", "phrase"))
            if rows.add(*_halves(phrase, list(zip(doc, at, n, strict=True)), hashes, length, gram, width)):
                yield rows.batch()
    if rows.size:
        yield rows.batch()


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by kind, hashes and place; gives copies, and what must be looked at closer.

    Rows of equal hashes after the first are copies. The first rows of each
    first hash that has several second hashes are given as well, with that hash
    as their trigger (and their bytes, where there are any). One row is carried over from batch to batch, however many rows a
    hash has.
    """
    held = None  # (h1, h2, doc, at, windows, bytes, given already)
    names = ("h1", "h2", "doc_id", "at", "windows")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        ready = kind == COPY
        h1, h2, doc, at, n = (batch.column(c).to_numpy() for c in names)
        phrase = np.full(len(kind), None, dtype=object)
        if "phrase" in batch.schema.names:
            phrase[:] = batch.column("phrase").to_pylist()
        none = lambda k: np.zeros(int(k.sum()), dtype=np.int64)
        out = [(np.full(int(ready.sum()), COPY), none(ready), doc[ready], at[ready], n[ready], phrase[ready])]
        h1, h2, doc, at, n, phrase = (x[~ready] for x in (h1, h2, doc, at, n, phrase))
        if len(h1):
            given = np.zeros(len(h1) + (held is not None), dtype=bool)
            if held is not None:
                h1, h2, doc, at, n, phrase = (np.concatenate([np.array([v], dtype=x.dtype), x]) for v, x in zip(held, (h1, h2, doc, at, n, phrase), strict=False))
                given[0] = held[6]
            new1, new2 = np.ones(len(h1), dtype=bool), np.ones(len(h1), dtype=bool)
            new1[1:] = h1[1:] != h1[:-1]
            new2[1:] = new1[1:] | (h2[1:] != h2[:-1])
            first = np.maximum.accumulate(np.where(new2, np.arange(len(h1)), 0))
            copy = ~new2 & ((doc != doc[first]) | (at != at[first]))
            out.append((np.full(int(copy.sum()), COPY), none(copy), doc[copy], at[copy], n[copy], np.full(int(copy.sum()), None)))
            group = np.cumsum(new1) - 1
            several = np.bincount(group, weights=new2) > 1
            several[0] |= bool(given[0])
            open_ = new2 & several[group] & ~given
            out.append((np.full(int(open_.sum()), FIRST), h1[open_], doc[open_], at[open_], n[open_], phrase[open_]))
            k = first[-1]
            held = (h1[k], h2[k], doc[k], at[k], n[k], phrase[k], bool(several[group[-1]]))
        columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        named = ["kind", "trigger", "doc_id", "at", "windows", "phrase"][: 6 if "phrase" in batch.schema.names else 5]
        yield pa.RecordBatch.from_arrays(columns[: len(named)], names=named)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix of ``data`` among all, compared to depth ``length`` (bytes beyond the end are 0).

    Prefix tripling: ranks to depth d at three places make ranks to depth 3 d,
    and two overlapping ones reach the exact depth. ``data`` holds fewer than
    2^21 bytes, so three ranks fit one 64-bit key.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)]).astype(np.uint64)
    depth = min(8, length)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(depth):
        key = key << np.uint64(8) | padded[i : i + n]

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        of = key[order]
        step = np.ones(n, dtype=np.uint64)
        step[1:] = of[1:] != of[:-1]
        out = np.zeros(n + length, dtype=np.uint64)  # 0: beyond the end
        out[order] = np.cumsum(step)
        return out

    rank = ranked(key)
    while depth < length:
        if 3 * depth <= length:
            key = rank[:n] << np.uint64(42) | rank[depth : depth + n] << np.uint64(21) | rank[2 * depth : 2 * depth + n]
            depth *= 3
        else:
            reach = min(2 * depth, length)
            key = rank[:n] << np.uint64(21) | rank[reach - depth : reach - depth + n]
            depth = reach
        rank = ranked(key)
    return rank[:n]


def _dictionary(batches: Iterator[pa.RecordBatch], length: int, gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the given phrases of a text, with their places; those of crowded triggers in parts under the hash of what is shared."""
    hashes, size, rows, crowded = RollingHash(CHUNK + 4 * length), 0, [], []
    names = ["trigger", "doc_id", "at", "windows", "phrase"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def cut() -> pa.RecordBatch:
        shared, _, doc, at, n, phrase = _halves([c[0] for c in crowded], [c[1] for c in crowded], hashes, length, gram, width)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((shared.view(np.int64), doc, at, n, phrase), kinds, strict=True)], names=names)

    for batch in batches:
        texts, docs, listed = batch.column(1).cast(pa.binary()), batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, doc in enumerate(docs):
            text = texts[i].as_py() or b""
            for p in listed[i]:
                phrase = text[p["at"] : p["at"] + p["windows"] + length - 1]
                if p["crowded"]:
                    crowded.append((phrase, (doc, p["at"], p["windows"])))
                    size += len(phrase)
                    if size >= CHUNK:
                        yield cut()
                        size, crowded = 0, []
                else:
                    rows.append((p["trigger"], doc, p["at"], p["windows"], phrase))
            if len(rows) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if crowded:
        yield cut()


BLOCK = 1 << 19  # bytes of a suffix array, and a group of one trigger beyond that


def _suffix_order(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows that start earlier elsewhere, from phrases sorted by trigger: one suffix array per run of whole triggers."""

    def covered(rows: list[tuple]) -> pa.RecordBatch:
        doc, at, n = (np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[1:4])
        rank = ranks(np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8), length)
        begin = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rank, doc, at = rank[np.repeat(begin, n) + within], np.repeat(doc, n), np.repeat(at, n) + within
        order = np.lexsort((at, doc, rank))
        rank, doc, at = rank[order], doc[order], at[order]
        copy = np.zeros(len(rank), dtype=bool)
        copy[1:] = rank[1:] == rank[:-1]
        doc, at = doc[copy], at[copy]
        # Neighbouring covered windows of a document make one row.
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(doc)))
        return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(at[first], pa.int64()), pa.array(many, pa.int32())], names=["doc_id", "at", "windows"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield covered(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield covered(held)


def _cover(starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered byte runs of windows [start, start + count)."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + counts + length - 1)[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > reach[:-1]
    return a[new], np.append(reach[:-1][new[1:]], reach[-1])


def _keep(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, spans, kept = text or b"", [], text or b""
            if runs:
                a, b = _cover(np.array([r["at"] for r in runs]), np.array([r["windows"] for r in runs]), length)
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
                edge = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2))
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
        n, removed, many, sha, spans, kept = map(list, zip(*rows, strict=True)) if rows else ([],) * 6
        columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64())]
        names = ["n_bytes", "n_removed", "n_spans"]
        if digest:
            columns, names = [*columns, pa.array(sha, pa.string())], [*names, "kept_sha256"]
        else:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [*columns, pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind), pa.array(kept, pa.binary())]
            names = [*names, "spans", "kept"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])


def remove_repeats(
    documents: DataFrame, *, length: int = 100, gram: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, hot: int = 512
) -> DataFrame:
    """One row per input row: bytes, removed bytes and runs, and what is kept (or its SHA-256).

    Null texts are empty; texts shorter than ``length`` lose nothing. Rows
    without an id come first in corpus order, as if their id were the smallest
    long. Rows that repeat an id with one text are one document and share its
    result; an id with several texts is read as the longest of them (largest
    in byte order among equals) for all of its rows. Other columns are not
    read. ``kept`` can end inside a character, as bytes are what is compared.
    """
    hot = min(hot, (1 << 20) // (2 * length))  # so that a suffix array's ranks fit 21 bits
    rows = documents.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = materialize(again, "repeated-ids")
    if not again.isEmpty():
        longest = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.octet_length("text").alias("n"), "text")).alias("t"))
        texts = rows.join(again, "doc_id", "left_anti").unionByName(longest.select("doc_id", F.col("t.text").alias("text")))
        rows = materialize(rows.select("doc_id").join(texts, "doc_id"), "texts")
    order = ("kind", "h1", "h2", "doc_id", "at")
    parsed = rows.mapInArrow(lambda it: _parse(it, length, gram), PARSED).repartition(F.col("place_by")).sortWithinPartitions(*order)
    grouped = materialize(parsed.mapInArrow(_group, FOUND), "phrases")
    first = grouped.where(F.col("kind") == FIRST)

    def crowded(entries: DataFrame) -> DataFrame:
        full = entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases")).where(F.col("phrases") > hot)
        return materialize(full.select("trigger", F.lit(True).alias("crowded")), "crowded")

    width = 1 << ((length - gram + 1).bit_length() - 1)  # of at most length - gram bytes before a trigger: two parts
    full = crowded(first)
    listed = first.join(full, "trigger", "left").groupBy("doc_id").agg(F.collect_list(F.struct("trigger", "at", "windows", "crowded")).alias("phrases"))
    entries = rows.join(listed, "doc_id").select("doc_id", "text", "phrases")
    kind = "trigger long, doc_id long, at long, windows int, phrase binary"
    entries = dictionary = materialize(entries.mapInArrow(lambda it, w=width: _dictionary(it, length, gram, w), kind), "dictionary")
    covered, ordered = [], []
    full = full if full.isEmpty() else crowded(entries)
    while not full.isEmpty():
        width = max(width // 2, 1)
        ordered.append(entries.join(full, "trigger", "left_anti"))
        parts = entries.join(full, "trigger", "left_semi").mapInArrow(lambda it, w=width: _parts(it, length, gram, w), PARSED + ", phrase binary")
        parts = parts.repartition(F.col("place_by")).sortWithinPartitions(*order)
        parts = materialize(parts.mapInArrow(_group, FOUND + ", phrase binary"), "parts")
        covered.append(parts.where(F.col("kind") == COPY).select("doc_id", "at", "windows"))
        entries = parts.where(F.col("kind") == FIRST).drop("kind")
        full = crowded(entries)
    for part in ordered:
        entries = entries.unionByName(part)
    entries = entries.repartition(F.col("trigger")).sortWithinPartitions("trigger")
    covered.append(materialize(entries.mapInArrow(lambda it: _suffix_order(it, length), "doc_id long, at long, windows int"), "dictionary-copies"))
    discard(dictionary)
    copies = grouped.where(F.col("kind") == COPY).select("doc_id", "at", "windows")
    for part in covered:
        copies = copies.unionByName(part)
    runs = copies.groupBy("doc_id").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))
    made = "n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "spans array<struct<start:bigint,end:bigint>>, kept binary")
    out = rows.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(lambda it: _keep(it, length, digest), f"doc_id long, {made}")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))
