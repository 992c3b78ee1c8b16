"""Models that are fitted once, stored with a fingerprint, and evaluated only where it fits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def data_fingerprint(rows: DataFrame) -> str:
    """Hash of a table's columns and rows, whatever their order; repeated rows count."""
    columns = sorted(rows.columns)
    each = [F.xxhash64(*map(F.col, columns)).cast("decimal(20,0)"), F.xxhash64(F.lit("again"), *map(F.col, columns)).cast("decimal(20,0)")]
    told = rows.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(e), F.lit(0)) for e in each)).first()
    return hashlib.sha256(json.dumps([columns, *map(str, told)]).encode()).hexdigest()


def fingerprint(train: DataFrame, parameters: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps([data_fingerprint(train), parameters], sort_keys=True, default=str).encode()).hexdigest()


def save(model: MLWritable, path: str, mark: str, spark: SparkSession) -> None:
    """The model, then its fingerprint: a model without one was not stored whole."""
    model.write().save(f"{path}/model")
    spark.createDataFrame([(mark, type(model).__name__)], "fingerprint string, kind string").coalesce(1).write.parquet(f"{path}/fingerprint")


def load(kind: type[MLReadable], path: str, mark: str, spark: SparkSession):
    """The stored model, if it is of that kind and was fitted on what ``mark`` stands for."""
    stored = spark.read.parquet(f"{path}/fingerprint").first()
    if stored["kind"] != kind.__name__ or stored["fingerprint"] != mark:
        raise ValueError(f"the stored model is {stored['kind']} {stored['fingerprint'][:12]}, expected {kind.__name__} {mark[:12]}")
    return kind.load(f"{path}/model")


def override_counts(rows: DataFrame, *, current: Column, proposed: Column, truth: Column, confidence: Column, caps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cap, rows, overrides, repaired, broken, correct)`` of a model that may replace a value above each cap.

    All caps are counted in one aggregate: an override counts for every cap that
    its confidence reaches.
    """
    over = lambda c: (confidence >= F.lit(c)) & ~proposed.eqNullSafe(current)
    count = lambda x, name: F.count_if(F.coalesce(x, F.lit(False))).alias(name)
    good, was = proposed.eqNullSafe(truth), current.eqNullSafe(truth)
    slots = [F.struct(F.lit(float(c)).alias("cap"), count(over(c), "overrides"), count(over(c) & good & ~was, "repaired"), count(over(c) & was, "broken"), count(F.when(over(c), good).otherwise(was), "correct")) for c in caps]
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.array(*slots).alias("slots"))
    return found.select(*by, "rows", F.explode("slots").alias("s")).select(*by, "s.cap", "rows", "s.overrides", "s.repaired", "s.broken", "s.correct")


def chosen_cap(counts: DataFrame, *, most_broken: float = 0.0) -> DataFrame:
    """The cap that repairs most among those that break at most that share of their overrides; of equal ones the highest."""
    fit = counts.where(F.col("broken") <= F.lit(most_broken) * F.col("overrides"))
    return fit.orderBy((F.col("repaired") - F.col("broken")).desc(), F.col("cap").desc()).limit(1)
