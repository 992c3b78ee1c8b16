"""Places in an order, spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion
from tessera.operators.ordering import numbered


def rows_of(n):
    rng = random.Random(3)
    groups = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(groups), rng.randrange(40), i) for i in range(n)]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbered_equals_sorting(spark, by):
    rows = rows_of(700)
    made = spark.createDataFrame(rows, "g string, s int, i int").repartition(5)
    got = {r.i: r.n for r in numbered(made, [F.col("s").desc(), F.col("i")], by=by, slices=9).collect()}
    want, seen = {}, {}
    for g, s, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g if by else None] = want[i] = seen.get(g if by else None, 0) + 1
    assert got == want


def test_hot_group_is_spread(spark):
    made = spark.createDataFrame([("hot", i) for i in range(900)], "g string, i int")
    placed = numbered(made, [F.col("i")], by=("g",), slices=9)
    # The window inside slices is partitioned by slice too: no window over the group's rows alone.
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "row_number" in line and "Window" in line]
    assert windows and all("_slice" in line.split("windowspecdefinition")[1] for line in windows)
    assert [r.n for r in placed.orderBy("i").collect()] == list(range(1, 901))


def test_empty_single_null_and_existing_column(spark):
    none = spark.createDataFrame([], "g string, s int")
    assert numbered(none, [F.col("s")]).count() == 0 and numbered(none, [F.col("s")], by=("g",)).count() == 0
    one = spark.createDataFrame([(None, None)], "g string, s int")
    assert [tuple(r) for r in numbered(one, [F.col("s")], by=("g",)).collect()] == [(None, None, 1)]
    again = spark.createDataFrame([("x", 5, 7), ("x", 5, 8)], "g string, s int, n int")
    assert sorted(r.n for r in numbered(again, [F.col("s")], by=("g",)).collect()) == [1, 2]


def test_percentiles_and_scaled_equal_their_window_forms(spark):
    rows = spark.createDataFrame([(q, i, float((i * 7 + q) % 5)) for q in range(3) for i in range(20)], "query int, item int, s double")
    a = {(r["query"], r["item"]): r.p for r in fusion.percentiles(rows, "s", by=("query",), out="p").collect()}
    assert a == {(r["query"], r["item"]): r.p for r in rows.select("*", fusion.rank_percentile("s").alias("p")).collect()}
    b = {(r["query"], r["item"]): r.scaled for r in fusion.scaled(rows, "s").collect()}
    assert b == {(r["query"], r["item"]): r.m for r in rows.select("*", fusion.min_max("s").alias("m")).collect()}
