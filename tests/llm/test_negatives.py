"""Hard negatives against every score."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.llm.negatives import Block, fitted_codebooks, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, anchor string, row_block int, residual int, vector int"


def plain(rows, anchor, positives=5, keep=3, scale=256):
    """rows: (id, vector, label), straight from the definition."""
    sound = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        sound[i] = min(sound.get(i, new), new)
    out = set()
    for a, (label, v) in sound.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, (other, w) in sound.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(n, i) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:keep]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fits, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1, 2, 3) for i, v, label in rows], SCHEMA)


def made(seed, n, width, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, width)) * 0.2
    label = rng.integers(0, labels, n)
    return [(i, (centre[k] + rng.normal(size=width) * 0.15).tolist(), int(k)) for i, k in enumerate(label)]


@pytest.mark.parametrize(("rows_block", "anchors_block", "width"), [(4096, 512, 16), (37, 5, 7)])
def test_hard_negatives(spark, monkeypatch, rows_block, anchors_block, width):
    monkeypatch.setattr(negatives, "ROWS_BLOCK", rows_block)
    monkeypatch.setattr(negatives, "ANCHORS_BLOCK", anchors_block)
    rows = made(width, 300, width)
    rows += [(1000, None, 1), (1001, [0.1] * width, None), (1002, [0.1, None], 1), (1003, [float("nan")] * width, 1), (1004, [float("inf")] * width, 1), (None, [0.5] * width, 1)]
    rows += [(2000, [0.3, -0.2], 1), (2010, [], 2), (2020, [0.0] * width, 1), (5, rows[5][1], 2), (5, rows[5][1], 0)]
    rows += [(3000 + i, rows[10][1], i % 2) for i in range(8)]  # equal vectors: ties
    got = [tuple(r) for r in hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == plain(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    assert hard_negatives(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives(frame(spark, [(1, [1.0, 2.0], 1), (3, [1.0, 2.5], 1)]), F.col("vec_id") % 50 == 0).collect() == []


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(2000, 32)) * 45).astype(np.int64)
    books = fitted_codebooks(x[:500].reshape(500, -1, 2).astype(float))
    import pandas as pd

    rows = next(negatives._encoder(books, 32)([pd.DataFrame({"id": np.arange(2000), "label": 0, "vector": list(x)})]))
    block = Block(rows, books, 32)
    low, high = block.bounds(x[:20])
    true = x[:20] @ x.T
    assert (low <= true).all() and (true <= high).all()
    fifth = np.sort(low, axis=1)[:, -5][:, None]
    assert (high >= fifth).mean() < 0.1
