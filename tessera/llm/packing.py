"""Length-bucketed packing with optimal bucket boundaries.

The global histogram of lengths goes through a dynamic programme that chooses
the bucket boundaries with the least padding; documents of a bucket, padded to
its boundary, then fill batches up to a token budget. The histogram has at
most ``budget / multiple`` entries, because lengths are rounded up to the
padding multiple and a text longer than the budget is a batch of its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.workspace import materialize


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``best[k][j]`` is the least padding of the j shortest distinct lengths in k
    buckets: the minimum over i of ``best[k-1][i] + b[j] * (C[j] - C[i]) - (S[j] - S[i])``
    with running counts C and sums S. For fixed k the candidates i are lines in
    ``b[j]`` with falling slopes and rising arguments, so their lower envelope
    answers each j in amortised constant time; the arithmetic is exact.
    """
    n = len(lengths)
    if not n:
        return []
    c, s = [0], [0]
    for length, count in zip(lengths, counts, strict=True):
        c.append(c[-1] + count)
        s.append(s[-1] + length * count)
    best = [lengths[j - 1] * c[j] - s[j] if j else 0 for j in range(n + 1)]
    back = [[0] * (n + 1)]
    for k in range(2, min(buckets, n) + 1):
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i)
        head, now, from_ = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if i >= k - 1:
                line = (-c[i], best[i] + s[i], i)
                while len(hull) - head >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                slope, intercept, from_[j] = hull[head]
                now[j] = slope * x + intercept + x * c[j] - s[j]
            else:
                now[j], from_[j] = best[j], j
        best = now
        back.append(from_)
    out, j = [], n
    for k in range(len(back) - 1, -1, -1):
        if j == 0:
            break
        if k and back[k][j] == j:
            continue
        out.append(lengths[j - 1])
        j = back[k][j] if k else 0
    return sorted(out)


# A blank between two characters that are no white space starts a word of the pattern, whatever stands around:
# the text can be cut before it. White space here includes all that the pattern counts as such.
_single_blank = re.compile(r"(?<=\S) (?=\S)")


def _token_counts(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    known: dict[str, int] = {}
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            n = 0
            for i, piece in enumerate(_single_blank.split(text or "")):
                piece = " " + piece if i else piece
                k = known.get(piece)
                if k is None:
                    if len(known) >= 300_000:
                        known.clear()
                    k = len(encoding.encode_ordinary(piece))
                    if len(piece) <= 64:
                        known[piece] = k
                n += k
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])


# Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_lengths(documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` per row: tokens of the whole text, 0 for null and empty texts.

    A text is cut before single blanks, where the pattern starts a word in any
    case, so the counts add up to those of the text in one piece.
    """
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _token_counts(it, ranks.value, PATTERN), f"doc_id {kind}, n_tokens long")


def pack(lengths: DataFrame, *, buckets: int = 16, budget: int = 65_536, multiple: int = 8, shard_rows: int = 4096) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_length, batch, slot`` for rows of (doc_id, n_tokens).

    Every row is placed once. Null counts are 0; a text of 0 tokens is padded
    to one multiple. Texts over the budget have bucket -1 and batches of one.
    Inside a bucket, rows are dealt to shards of about ``shard_rows`` by a hash
    of id and length and numbered there; running shard sizes turn that into an
    exact numbering of the whole bucket, so all batches but the last are full
    and no bucket, however large, is sorted by one task. Rows that repeat an id
    are rows of their own.
    """
    spark = lengths.sparkSession
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    padded = F.greatest(F.ceil(n / F.lit(multiple)), F.lit(1)) * F.lit(multiple)
    rows = materialize(
        lengths.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.alias("n_tokens"), padded.cast("long").alias("rounded")), "lengths"
    )
    histogram = rows.where(F.col("rounded") <= budget).groupBy("rounded").count().orderBy("rounded").collect()
    ends = optimal_boundaries([r["rounded"] for r in histogram], [r["count"] for r in histogram], buckets)
    sizes = np.zeros(max(len(ends), 1), dtype=np.int64)
    for r in histogram:
        sizes[np.searchsorted(ends, r["rounded"])] += r["count"]
    bound = F.array(*map(F.lit, ends)) if ends else F.array().cast("array<int>")
    bucket = F.when(F.col("rounded") > budget, F.lit(-1)).otherwise(F.size(F.filter(bound, lambda b: b < F.col("rounded")))).cast("int")
    shards = F.get(F.array(*(F.lit(int(-(-k // shard_rows)) or 1) for k in sizes)), F.greatest("bucket", F.lit(0)))
    rows = rows.withColumn("bucket", bucket).withColumn("padded_length", F.when(F.col("bucket") < 0, F.col("rounded")).otherwise(F.get(bound, F.greatest("bucket", F.lit(0)))).cast("long"))
    own = rows.where("bucket < 0").select(
        "doc_id", "n_tokens", "bucket", "padded_length", F.concat(F.lit("-1:"), F.col("row").cast("string")).alias("batch"), F.lit(0).cast("long").alias("slot")
    )
    rows = rows.where("bucket >= 0").withColumn("shard", F.pmod(F.xxhash64("row", "n_tokens"), shards).cast("int"))
    counted = materialize(rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("held")), "shards")
    before = F.sum("held").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row"))
    numbered = rows.withColumn("place", place).join(counted, ["bucket", "shard"]).withColumn("at", F.col("before") + F.col("place") - 1)
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded_length")), F.lit(1))
    packed = numbered.select(
        "doc_id", "n_tokens", "bucket", "padded_length",
        F.concat_ws(":", "bucket", F.floor(F.col("at") / room)).alias("batch"), (F.col("at") % room).cast("long").alias("slot"),
    )
    return packed.unionByName(own)


def pack_documents(documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Packs whole texts, of any length, by their token counts; other columns are not read."""
    return pack(token_lengths(documents, vocabulary, id_col=id_col, text_col=text_col), **options)
