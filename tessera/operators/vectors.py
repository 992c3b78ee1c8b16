"""Vector retrieval: exact inner product, multi-vector late interaction, sign hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import dot, l2_normalized
from tessera.operators.products import best_by_group
from tessera.sources.tables import small


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("item"), l2_normalized(F.col(vector_col)).alias("v"))


def inner_products(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``(query, item, score)`` for a stated query set (query, v) against all items (item, v).

    A query set whose size is checked to be small is broadcast; every row of
    items is then scored where it is read, without a shuffle.
    """
    return items.join(small(queries.withColumnRenamed("v", "q"))).select("query", "item", dot(F.col("q"), F.col("v")).alias("score"))


def maxsim(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Late interaction: sum over query vectors of the best product with any passage vector.

    ``queries`` holds (query, slot, v), ``passages`` (passage, v); null vectors
    are padding and never win.
    """
    best = best_by_group(queries.where("v is not null"), passages.where("v is not null"))
    return best.groupBy("query", "passage").agg(F.sum("best").alias("score"))


def mean_pooled(chunks: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """Normalised mean of the vectors of each group, position by position."""
    each = chunks.select(F.col(group_col).alias("item"), F.posexplode(vector_col).alias("place", "x"))
    means = each.groupBy("item", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = means.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("v"))
    return lists.select("item", l2_normalized(F.col("v")).alias("v"))


def sign_hash(vector, bits: int = 64):
    """Number whose bit i says whether component i is positive."""
    powers = F.array(*(F.shiftleft(F.lit(1).cast("long"), i) for i in range(bits)))
    parts = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.get(powers, i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x)


def near_hashes(hashes: DataFrame, distance: int, *, bits: int = 64, agree: int = 3) -> DataFrame:
    """Pairs (a, b, distance) of items whose hashes differ in at most ``distance`` bits.

    The bits are cut into ``distance + agree`` blocks. Close hashes agree on
    ``agree`` of them entirely, so pairs meet by an equality join on the values
    of every choice of that many blocks. With three, a key has 24 of 64 bits
    and hardly any two hashes meet that are not close. Equal hashes meet once
    under each of their keys, distinct pairs once in the result.
    """
    from itertools import combinations

    blocks = distance + agree
    edge = [bits * i // blocks for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned(F.col("h"), edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1).cast("long"))
    keys = F.array(*(F.struct(F.lit(n).alias("choice"), F.xxhash64(*(part(i) for i in c)).alias("value")) for n, c in enumerate(combinations(range(blocks), agree))))
    each = hashes.select("item", "h", F.explode(keys).alias("key"))
    a = each.select(F.col("item").alias("a"), F.col("h").alias("ha"), "key")
    b = each.select(F.col("item").alias("b"), F.col("h").alias("hb"), "key")
    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (apart <= distance)).select("a", "b", apart.cast("long").alias("distance")).distinct()
