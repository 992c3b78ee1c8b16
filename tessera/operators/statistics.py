"""Quantiles, grouped bootstrap, threshold and grid selection, small linear models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.sources.workspace import materialize

from tessera.functions.numbers import safe_ratio


def linear_quantiles(value: str, *shares: float) -> list[Column]:
    """Exact quantiles with linear interpolation at (n - 1) q."""
    return [F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}") for q in shares]


def nearest_rank_quantiles(rows: DataFrame, by: list[str], value: str, *shares: float) -> DataFrame:
    """Quantiles as the value at rank ceil(q n), counted from 1."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(value)
    reached = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col(value))).alias(f"nearest_p{round(q * 100)}") for q in shares]
    return reached.groupBy(*by).agg(*picks)


def paired_bootstrap(rows: DataFrame, *, group: str, baseline: str, contender: str, repetitions: int = 1000, seed: int = 17, level: float = 0.95) -> DataFrame:
    """Mean difference contender - baseline with a percentile interval from resampled groups.

    Each group occurs Poisson(1) times in a repetition, drawn from a hash of
    (seed, repetition, group): a group needs no knowledge of the others, so
    the sums of all repetitions come from one aggregate over groups that are
    already reduced to their sums.
    """
    sums = rows.groupBy(F.col(group).alias("g")).agg(F.sum(F.col(contender) - F.col(baseline)).alias("d"), F.count(F.lit(1)).alias("n"))
    draws = sums.select("g", "d", "n", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", "g"), F.lit(1 << 30)).cast("double") + 0.5) / F.lit(float(1 << 30))
    # Cumulative Poisson(1) probabilities.
    steps, p, total = [], 0.36787944117144233, 0.0
    for i in range(1, 9):
        total += p
        steps.append(total)
        p /= i
    times = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    weighted = draws.withColumn("w", times)
    means = weighted.groupBy("rep").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    interval = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("p_better"))
    return sums.agg((F.sum("d") / F.sum("n")).alias("difference"), F.count(F.lit(1)).alias("n_groups")).crossJoin(interval)


def threshold_sweep(rows: DataFrame, *, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Balanced accuracy and accuracy of "score >= threshold" at each observed score, 0 and 1.

    Distinct scores are counted first; running sums over them give every
    threshold's confusion counts in one ordered pass.
    """
    counts = rows.groupBy(*by, F.col(score).cast("double").alias("t")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ends = rows.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).distinct().select(*by, "t", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    points = counts.unionByName(ends).groupBy(*by, "t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.partitionBy(*by).orderBy(F.col("t").desc())
    whole = Window.partitionBy(*by)
    points = points.select(*by, "t", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    tn = F.col("n") - F.col("fp")
    balanced = (safe_ratio(F.col("tp"), F.col("p")) + safe_ratio(tn, F.col("n"))) / 2
    return points.select(*by, F.col("t").alias("threshold"), balanced.alias("balanced_accuracy"), safe_ratio(F.col("tp") + tn, F.col("p") + F.col("n")).alias("accuracy"))


def best_by(rows: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The first row in ``order``, of each group if any."""
    if not by:
        return rows.orderBy(*order).limit(1)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def near_optimal(points: DataFrame, *, accuracy: str, k: str, tolerance: float = 0.03, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Among points within ``tolerance`` of the best accuracy, the smallest k, then ``ties``."""
    best = points.agg(F.max(accuracy).alias("_best"))
    return points.crossJoin(F.broadcast(best)).where(F.col(accuracy) >= F.col("_best") - F.lit(tolerance) - F.lit(1e-12)).drop("_best").orderBy(k, F.col(accuracy).desc(), *ties).limit(1)


def apportioned(rows: DataFrame, *, weight: str, key: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total`` by weight; equal remainders by key."""
    whole = rows.agg(F.sum(weight).alias("_w"))
    quota = rows.crossJoin(F.broadcast(whole)).select(key, (F.lit(total) * F.col(weight) / F.col("_w")).alias("quota"))
    floors = quota.withColumn("base", F.floor("quota"))
    spare = F.lit(total) - F.sum("base").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.round(F.col("quota") - F.col("base"), 9).desc(), key)
    return floors.withColumn("extra", (F.row_number().over(order) <= spare).cast("long")).select(key, (F.col("base") + F.col("extra")).alias("target"))


def fit_logistic(rows: DataFrame, features: list[str], label: str, *, l2: float = 0.03):
    """Class-balanced, standardised logistic model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    steps = [
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_weight", regParam=l2, standardization=False, maxIter=100),
    ]
    return Pipeline(stages=steps).fit(rows.withColumn("_weight", weight))


def fit_multinomial(rows: DataFrame, vector: str, label: str, *, l2: float = 0.01):
    """Multinomial logistic model with classes weighted by the inverse of their size."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    sizes = rows.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("_weight"))
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep")
    model = LogisticRegression(featuresCol=vector, labelCol="_label", weightCol="_weight", family="multinomial", regParam=l2, maxIter=50)
    return Pipeline(stages=[index, model]).fit(rows.join(F.broadcast(sizes), label))


def char_gram_counts(text: Column, n: int = 3, features: int = 4096) -> Column:
    """Counts of lower-case character ``n``-grams, hashed to ``features`` places, as a vector.

    Grams are hashed in an Arrow batch over the text's code points, so no
    array of grams is ever built.
    """
    from pyspark.ml.functions import array_to_vector

    @pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        def one(t):
            codes = np.frombuffer((t or "").lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            if len(codes) < n:
                return np.zeros(features)
            key = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for i in range(n):
                key = (key ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            return np.bincount((key % np.uint64(features)).astype(np.int64), minlength=features).astype(float)

        return texts.map(one)

    return array_to_vector(counted(text))


def fit_text_forest(rows: DataFrame, text: str, label: str, *, n: int = 3, trees: int = 20, features: int = 1024, seed: int = 17):
    """Random forest over hashed, IDF-weighted character n-grams; ``(model, rows with their counts)``.

    The counts are written once: the weights, the trees and the predictions read them.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IDF

    counted = materialize(rows.withColumn("_tf", char_gram_counts(F.col(text), n, features)).drop(text), "char-grams")
    steps = [IDF(inputCol="_tf", outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=6, seed=seed)]
    return Pipeline(stages=steps).fit(counted), counted


def out_of_fold(rows: DataFrame, fold: str, folds: int, fit) -> DataFrame:
    """Predictions for each row by a model that saw no row of its fold; ``fit(rows)`` gives a model."""
    parts = [fit(rows.where(F.col(fold) != k)).transform(rows.where(F.col(fold) == k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
