"""Numeric, vector and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    # The length is bound to a name: inside the lambda it would be computed for every component.
    scaled = lambda length: F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def stable_key(*parts: Column) -> Column:
    """Hexadecimal sort key that depends on the values alone."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def stable_fraction(*parts: Column) -> Column:
    """The first 52 bits of the stable key as a number in [0, 1)."""
    return F.conv(F.substring(stable_key(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def geometric_mean(values: Column, floor: float = 1e-9) -> Column:
    logs = F.transform(values, lambda v: F.ln(F.greatest(v, F.lit(floor))))
    return F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(values), F.lit(1)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)
