"""Hard negatives by product quantisation with rigorous score bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.workspace import materialize

PART = 2  # components a codebook covers
CENTROIDS = 256  # entries of a codebook: one byte a part
SAMPLE = 4_096  # vectors that codebooks are fitted on
ROUNDS = 8  # of Lloyd's algorithm
ROWS_BLOCK, ANCHORS_BLOCK = 4_096, 512  # rows and anchors that one task compares
STEP = 64  # anchors whose scores are in memory at once


def fitted_codebooks(sample: np.ndarray) -> np.ndarray:
    """Codebooks (parts, CENTROIDS, PART) of vectors (n, parts, PART): k-means a part, from evenly spaced vectors in order."""
    n, parts, _ = sample.shape
    books = np.zeros((parts, CENTROIDS, PART))
    for m in range(parts if n else 0):
        x = sample[:, m]
        ordered = x[np.lexsort(x.T[::-1])]
        c = ordered[(np.arange(CENTROIDS) * n) // CENTROIDS].copy()
        for _ in range(ROUNDS):
            near = _nearest(x, c)
            size = np.bincount(near, minlength=CENTROIDS)
            for k in range(PART):
                total = np.bincount(near, weights=x[:, k], minlength=CENTROIDS)
                c[:, k] = np.where(size > 0, total / np.maximum(size, 1), c[:, k])
        books[m] = c
    return books


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def _parts(vectors: np.ndarray) -> np.ndarray:
    """Vectors (n, width) as doubles (n, parts, PART), padded with zeros."""
    n, width = vectors.shape
    parts = -(-width // PART)
    full = np.zeros((n, parts * PART))
    full[:, :width] = vectors
    return full.reshape(n, parts, PART)


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _encoder(books: np.ndarray, width: int):
    """Adds codes and the norm of what they leave over."""

    def encode(frames):
        for rows in frames:
            x = _parts(_stacked(rows["vector"], width))
            codes = np.zeros(x.shape[:2], dtype=np.uint8)
            for m in range(x.shape[1]):
                codes[:, m] = _nearest(x[:, m], books[m])
            rest = x - books[np.arange(x.shape[1]), codes]
            yield rows.assign(codes=[c.tobytes() for c in codes], residual=np.sqrt((rest**2).sum(axis=(1, 2))))

    return encode


class Block:
    """A block of coded rows, and bounds of their scores with anchors."""

    def __init__(self, rows: pd.DataFrame, books: np.ndarray, width: int):
        self.books, self.width = books, width
        self.id, self.label = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.vector, self.residual = _stacked(rows["vector"], width), rows["residual"].to_numpy(np.float64)
        self.codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of every anchor (n, width) with every row: the table look-ups, give or take anchor norm times residual norm."""
        x = _parts(anchors)
        table = np.einsum("nmk,mck->mnc", x, self.books)
        score = np.zeros((len(anchors), len(self.id)))
        for m in range(x.shape[1]):
            score += table[m][:, self.codes[:, m]]
        norm = np.sqrt((x**2).sum(axis=(1, 2)))[:, None]
        # Scores are integers: half a point more than covers what rounding of doubles can add.
        spread = norm * self.residual * (1 + 1e-9) + 1e-9 * np.abs(score) + 0.5
        return score - spread, score + spread

    def best(self, anchor: np.ndarray, among: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, k: int, fits=None) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows ``among`` those given by exact score, then id; ``sure`` are those whose score certainly fits.

        A row whose greatest score is under the k-th greatest least score of sure rows cannot be one of them.
        """
        least = low[sure]
        if len(least) > k:
            among = among[high[among] >= np.partition(least, len(least) - k)[len(least) - k]]
        score = self.vector[among] @ anchor
        if fits is not None:
            keep = fits(score)
            among, score = among[keep], score[keep]
        order = np.lexsort((self.id[among], -score))[:k]
        return among[order], score[order]


def _positives(books: np.ndarray, width: int, k: int):
    def find(key, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(anchors):
            block = Block(rows, books, width)
            ids, labels, vectors = anchors["id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), _stacked(anchors["vector"], width)
            for a in range(0, len(ids), STEP):
                low, high = block.bounds(vectors[a : a + STEP])
                for i in range(len(low)):
                    same = np.flatnonzero((block.label == labels[a + i]) & (block.id != ids[a + i]))
                    at, score = block.best(vectors[a + i], same, low[i], high[i], same, k)
                    found += zip([ids[a + i]] * len(at), block.id[at], score, strict=True)
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score"], dtype=np.int64)

    return find


def _negatives(books: np.ndarray, width: int, k: int, least: int, most: int):
    def find(key, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(anchors):
            block = Block(rows, books, width)
            ids, labels, vectors = anchors["id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), _stacked(anchors["vector"], width)
            for a in range(0, len(ids), STEP):
                low, high = block.bounds(vectors[a : a + STEP])
                for i in range(len(low)):
                    other = np.flatnonzero(block.label != labels[a + i])
                    l100, h100 = 100 * low[i], 100 * high[i]
                    for positive in anchors["positives"].iloc[a + i]:
                        s = int(positive["positive_score"])
                        among = other[(h100[other] >= least * s) & (l100[other] <= most * s)]
                        sure = among[(l100[among] >= least * s) & (h100[among] <= most * s)]
                        at, score = block.best(vectors[a + i], among, low[i], high[i], sure, k, lambda x, s=s: (100 * x >= least * s) & (100 * x <= most * s))
                        found += zip([ids[a + i]] * len(at), [positive["positive_id"]] * len(at), [s] * len(at), block.id[at], score, strict=True)
        return pd.DataFrame(found, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], dtype=np.int64)

    return find


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95
) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x); a score is the integer inner product.
    An anchor's positives are its best rows of the same label, its negatives
    the best rows of other labels with a score of ``least`` to ``most`` percent
    of the positive's. Ties go to the smaller id.

    Every row is indexed: codebooks for pairs of components are fitted on
    ``SAMPLE`` rows drawn by hash of their id, and each row keeps its codes and
    the norm of what they leave over. Blocks of rows meet blocks of anchors;
    in a task, table look-ups plus or minus anchor norm times residual norm
    bound every score, and only rows that can be among the best are scored
    with integers. So the result is exact whatever the codebooks; recall is 1.
    A task sends its own best rows of an anchor, the last cut is over those.

    Rows with a null id, label or vector, or with a null or non-finite
    component take no part. Of rows that repeat an id, the one with the
    smallest label, then vector counts. A shorter vector counts as padded with
    zeros; scores must fit into 64 bits. ``is_anchor`` is a column over
    ``vectors`` and may hold for any number of rows. Other columns are not read.
    """
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    row = F.struct(F.col(label_col).cast("long").alias("label"), ints.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), row.alias("row"))
    rows = materialize(rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*"), "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    width = max(int(total["width"]), 1)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()
    books = fitted_codebooks(_parts(_stacked(drawn["vector"], width)))
    coded = rows.mapInPandas(_encoder(books, width), "id long, label long, vector array<long>, anchor boolean, codes binary, residual double")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    row_blocks, anchor_blocks = -(-total["rows"] // ROWS_BLOCK) or 1, -(-total["anchors"] // ANCHORS_BLOCK) or 1
    index = materialize(coded.withColumns({"row_block": deal(row_blocks), "anchor_block": deal(anchor_blocks)}), "codes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = index.select("id", "label", "vector", "codes", "residual", "row_block").withColumn("anchor_block", every(anchor_blocks)).groupBy("row_block", "anchor_block")
    anchors = index.where("anchor").select("id", "label", "vector", "anchor_block")
    met = grid.cogroup(anchors.withColumn("row_block", every(row_blocks)).groupBy("row_block", "anchor_block"))
    near = met.applyInPandas(_positives(books, width, positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    chosen = near.withColumn("place", place).where(F.col("place") <= positives)
    chosen = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = materialize(anchors.join(chosen, "id"), "positives")
    met = grid.cogroup(asked.withColumn("row_block", every(row_blocks)).groupBy("row_block", "anchor_block"))
    found = met.applyInPandas(_negatives(books, width, negatives, least, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
