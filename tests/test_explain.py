import pytest

from datetime import date

from pyspark.sql import functions as F

from tessera.operators.conditions import date_forms, distinct_forms, structured
from tessera.operators.evidence import dates_on
from tessera.operators.explain import best_assignment, backend_answers
from tessera.operators.studies import apportion


def test_best_assignment():
    sizes = {"a": {"x": 3}, "b": {"x": 1}, "c": {"x": 1}}
    targets = {"x": {"train": 3, "test": 1, "dev": 1}}
    got = best_assignment(sizes, targets, {"train": 0.6, "test": 0.2, "dev": 0.2}, lambda s: hash(s) % 7)
    assert got["a"] == "train" and {got["b"], got["c"]} == {"test", "dev"}
    with pytest.raises(ValueError):
        best_assignment(sizes, {"x": {"train": 2, "test": 1, "dev": 1}}, {"train": 0.6, "test": 0.2, "dev": 0.2}, len)


def test_apportion():
    assert apportion(10, {"a": 0.7, "b": 0.15, "c": 0.15}) == {"a": 7, "b": 2, "c": 1}
    assert sum(apportion(7, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).values()) == 7


def test_failing_backend(spark):
    def fails(queries):
        raise TimeoutError

    rows = spark.createDataFrame([("A  b",), ("a b",), ("",)], "query string")
    assert [tuple(r) for r in backend_answers(rows, fails).collect()] == [("a b", None)]


def test_dates(spark):
    assert date_forms(1999, 13, 1) == () and date_forms(2024, 5, 1)[-1] == "May 1, 2024"
    text = F.lit("12.9.49 and 2024/02/30 Sept 1, 1999 Dec. 9th, 1999 JAN 3,50 1999年12月31日 may 5 2101")
    assert set(spark.range(1).select(dates_on(text).alias("d")).first().d) == {date(2049, 12, 9), date(1999, 12, 9), date(1950, 1, 3), date(1999, 12, 31)}
    assert distinct_forms(("A-1", " a 1 ", "b", "?")) == ("A-1", "b")


def test_structured_conditions():
    found = {c.source: c.label for c in structured("标题为年度总结、制造商：ACME，编号：AB-12，北京某某有限公司的报告 HS-40")}
    assert found["structured_identifier"] == "AB-12" and found["named_field"] in ("年度总结", "ACME")
    assert "北京某某有限公司" in [c.label for c in structured("查找北京某某有限公司的登记表")]


def test_near_hashes_find_all(spark):
    """Every pair within the distance meets under some key; none beyond it is given."""
    import random

    from tessera.operators.vectors import near_hashes

    draw = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    base = [draw.getrandbits(64) for _ in range(12)]
    rows = list(base)
    for b in base:
        for flips in (0, 1, 4, 5, 6, 7):
            x = b
            for bit in draw.sample(range(64), flips):
                x ^= 1 << bit
            rows.append(x)
    want = {(i, j, (rows[i] ^ rows[j]).bit_count()) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (rows[i] ^ rows[j]).bit_count() <= 5}
    hashes = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(rows)], "item int, h long")
    assert {tuple(r) for r in near_hashes(hashes, 5).collect()} == want and len(want) > 40
