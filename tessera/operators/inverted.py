"""An inverted-file vector index: cells as Parquet partitions, idempotent appends, exact scores of what is probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.products import best_products

SAMPLE = 4_096  # vectors that the cells' centres are fitted on
ROUNDS = 10


def create_index(root: str, vectors: DataFrame, *, item: str, vector: str, cells: int) -> None:
    """Fits the centres of ``cells`` cells on a bounded sample by hash and writes them; the index is empty."""
    drawn = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(item), item).limit(SAMPLE).select(vector).toPandas()
    x = np.stack([np.asarray(v, dtype=np.float64) for v in drawn[vector]])
    cells = min(cells, len(x))
    centres = x[np.arange(cells) * len(x) // cells].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    rows = [(int(c), [float(a) for a in v]) for c, v in enumerate(centres)]
    vectors.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{root}/centres")


def _centres(spark: SparkSession, root: str) -> np.ndarray:
    rows = sorted(spark.read.parquet(f"{root}/centres").collect(), key=lambda r: r.cell)
    return np.array([r.centre for r in rows])


def _nearest(rows: DataFrame, column: str, centres: np.ndarray, probe: int) -> DataFrame:
    """Adds ``cells``: the ``probe`` nearest cells, nearest first."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in f[column]])
                order = np.argsort((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1, kind="stable")[:, :probe]
                yield f.assign(cells=list(order.astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(assign, f"{fields}, cells array<int>")


def indexed(spark: SparkSession, root: str) -> DataFrame | None:
    """``(item, v, cell)`` of the index; none before the first append."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/vectors")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{root}/vectors") if there else None


def append(root: str, vectors: DataFrame, *, item: str, vector: str) -> None:
    """Adds items that the index does not hold yet; a repeated append adds nothing.

    Of rows that repeat an item the smallest vector counts. Null items and
    vectors are left out. Only the ids of the index are read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(item).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.min(F.col(vector).cast("array<float>")).alias("v"))
    known = indexed(spark, root)
    if known is not None:
        rows = rows.join(known.select("item"), "item", "left_anti")
    dealt = _nearest(rows, "v", _centres(spark, root), 1).select("item", "v", F.get("cells", F.lit(0)).alias("cell"))
    # A cell's rows come from a few tasks each: no file per task and cell, no task that holds a whole cell.
    dealt.repartition(F.col("cell"), F.pmod(F.xxhash64("item"), F.lit(4))).write.partitionBy("cell").mode("append").parquet(f"{root}/vectors")


def search(root: str, queries: DataFrame, *, query: str, vector: str, k: int, probe: int) -> DataFrame:
    """``(query, item, score, rank)``: the ``k`` best items by exact inner product among those of the ``probe`` nearest cells.

    Blocks of queries meet blocks of items of the same cell. With ``probe`` as large as the number of
    cells the result is exact.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("query"), F.col(vector).cast("array<float>").alias("q"))
    asked = _nearest(asked, "q", _centres(spark, root), probe).select("query", "q", F.explode("cells").alias("cell"))
    return best_products(asked.withColumnRenamed("q", "v"), indexed(spark, root), k, others=False, by=("cell",)).select("query", "item", "score", "rank")
