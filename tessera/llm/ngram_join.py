"""N-gram Jaccard join by multiple-global-order filtering.

Documents are sets of word shingles; two link when
``den * |x & y| >= num * |x | y|``. Three global orders of the shingles filter
candidates before any pair of sets is compared:

* **A, ascending hash.** Linked sets share at least ``l`` shingles among the
  ``g + l`` smallest of each (``g`` = most shingles one of the two can lack).
  Only that extended prefix of every document is shuffled. Document
  frequencies are counted exactly over these prefixes; inside one, linked sets
  must share one of the rarest ``len - l + 1``, so a document whose rare end
  occurs nowhere else has no partner and leaves. Of the documents that stay, a
  pair must share one of the ``g + 1`` smallest.
* **B, rarest first**, over the whole sets of the documents that remain.
  Linked sets share one of their ``g + 1`` rarest shingles, and the place of
  the first shared one bounds the overlap from above for the pair at hand.
* **C, descending hash of another mix.** Linked sets share one of the ``g + 1``
  first shingles here as well.

A pair must meet in all three, in B under the bound, before its whole sets
are fetched and compared. Equal sets are merged first. In each posting list all
members are first compared with the member that has the fewest unique
shingles; lists that then lie in one component need no other pair, which keeps
groups of copies linear. Lists that still span several components are joined
across components only, so no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import WordHashes, mixed, shingle_set
from tessera.operators.graph import connected_components
from tessera.sources.workspace import discard, materialize


def _lack(n, num, den):
    """Most shingles of an n-set that a linked set may lack; works on ints and Columns alike."""
    if isinstance(n, (int, np.integer)):
        return int(n) - (num * int(n) + den - 1) // den
    return n - F.floor((F.lit(num) * n + F.lit(den - 1)) / F.lit(den)).cast("int")


def _sketch(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """Set size, set key and extended A-prefix of each text."""
    words = WordHashes()
    for batch in batches:
        n, keys, heads = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            s = shingle_set(text, size, words)
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            heads.append(s[: min(len(s), stretch * _lack(len(s), num, den) + 1)].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), _lists(heads, pa.int64())],
            names=["doc_id", "n", "set_key", "head"],
        )


def _whole(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Whole set, A-prefix and C-prefix (32 bits a shingle) of each text that has the given set key."""
    words = WordHashes()
    for batch in batches:
        ids, sets, fronts, tails = [], [], [], []
        for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            s = shingle_set(text, size, words)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != key:  # another text of a repeated id
                continue
            c, g = mixed(s ^ np.uint64(0x5851F42D4C957F2D)), _lack(len(s), num, den)
            ids.append(doc)
            sets.append(s.view(np.int64))
            fronts.append((s[: g + 1] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            tails.append(np.partition(c, len(c) - g - 1)[len(c) - g - 1 :].astype(np.uint32).view(np.int32))
        columns = [pa.array(ids, pa.int64()), _lists(sets, pa.int64()), _lists(fronts, pa.int32()), _lists(tails, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shingles", "front", "tail"])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, dtype=kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _linked(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that meet in orders A and C and whose whole sets are similar enough."""
    side = lambda p, *cs: whole.select(F.col("doc_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in cs))
    both = pairs.join(side("a", "front", "tail"), "a").join(side("b", "front", "tail"), "b")
    met = both.where(F.arrays_overlap("a_front", "b_front") & F.arrays_overlap("a_tail", "b_tail")).select("a", "b")
    met = materialize(met, "candidates")
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    similar = F.lit(den + num) * both >= F.lit(num) * (F.size("a_shingles") + F.size("b_shingles"))
    full = met.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b").where(similar)
    links = materialize(full.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links")
    discard(met)
    return links


def _shared_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of (doc_id, n, token) that occur in two rows or more, with their frequency."""
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return tokens.join(materialize(often, "frequencies"), "token")


def ngram_jaccard_components(
    documents: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, stretch: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable over links, itself included.
    Texts of any length are read whole. Null, empty and word-free texts have no shingles and link with nothing.
    A row without an id links with nothing and has a null component. Rows that
    repeat an id are one node, linked by the text with the smallest set key;
    each row gets its own size and the node's component. Other columns of the
    input are not read, whatever their names.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = texts.mapInArrow(lambda it: _sketch(it, size, num, den, stretch), "doc_id long, n int, set_key binary, head array<bigint>")
    sets = materialize(sets, "sets")
    primary = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("set_key"), F.count(F.lit(1)).alias("many"))
    rep = materialize(primary.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")

    # Order A: documents whose rare end is shared by no other leave here.
    lack = _lack(F.col("n"), num, den)
    length = F.least(F.col("n"), F.lit(stretch) * lack + 1)
    smallest = F.floor((F.lit(num) * F.col("n") + F.lit(den - 1)) / F.lit(den)).cast("int")  # of a linked set
    least_lack = _lack(smallest, num, den)
    least_shared = F.least(smallest, F.lit(stretch) * least_lack + 1) - least_lack
    tokens = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", F.explode("head").alias("token"))
    partners = _shared_tokens(tokens).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    partners = partners.where(length - F.col("shared") < length - least_shared + 1).select("doc_id").distinct()
    open_ids = materialize(partners.join(rep.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "open")

    # Order B over whole sets.
    keyed = open_ids.join(rep.select(F.col("rep").alias("doc_id"), "set_key"), "doc_id")
    whole = texts.join(keyed, "doc_id").select("doc_id", "text", "set_key")
    whole = whole.mapInArrow(lambda it: _whole(it, size, num, den), "doc_id long, shingles array<bigint>, front array<int>, tail array<int>")
    if not primary.where("many > 1").isEmpty():
        whole = whole.dropDuplicates(["doc_id"])
    whole = materialize(whole, "open-sets")
    tokens = whole.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    ranked = _shared_tokens(tokens).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("list")).where(lack >= F.col("alone"))
    index = ranked.select("doc_id", "n", "alone", F.posexplode(F.slice("list", F.lit(1), lack + 1 - F.col("alone"))).alias("at", "entry"))
    # left: shingles from this one on, itself included; no more than that can be shared.
    index = index.select("doc_id", "n", "alone", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("entry.token").alias("token"))
    index = materialize(index, "index")

    def possible(n, left, m, other):
        return F.lit(den + num) * F.least(left, other) >= F.lit(num) * (n + m)

    pivot = index.groupBy("token").agg(F.min(F.struct("alone", "doc_id", "n", "left")).alias("p"), F.count(F.lit(1)).alias("many")).where("many > 1")
    first = (
        index.join(pivot.select("token", "p"), "token")
        .where((F.col("doc_id") != F.col("p.doc_id")) & possible(F.col("n"), F.col("left"), F.col("p.n"), F.col("p.left")))
        .select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"))
        .distinct()
    )
    first = materialize(first, "pivot-pairs")
    links = _linked(first, whole, num, den)

    # Posting lists that still span several components: pairs across components only.
    node = connected_components(links)
    placed = index.join(node.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "doc_id")), "placed")
    several = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    spread = placed.join(several, "token", "left_semi")
    x = spread.select("token", *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "left", "component")))
    y = spread.select("token", *(F.col(c).alias(f"y_{c}") for c in ("doc_id", "n", "left", "component")))
    across = (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_component") != F.col("y_component"))
    rest = (
        x.join(y, (x["token"] == y["token"]) & across & possible(F.col("x_n"), F.col("x_left"), F.col("y_n"), F.col("y_left")))
        .select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    rest = materialize(rest, "cross-pairs")
    more = _linked(rest, whole, num, den)
    discard(rest, first, index, placed, whole)
    groups = connected_components(links.unionByName(more))

    placed_ids = primary.join(rep, "set_key").join(groups, F.col("rep") == F.col("node"), "left")
    placed_ids = placed_ids.select("doc_id", F.coalesce("component", "rep").alias("component"))
    return sets.join(placed_ids, "doc_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
