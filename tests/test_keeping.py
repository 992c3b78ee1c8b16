"""Constraints, migrations, frozen models, reporting batches, gate features, evidence of pages."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import conditions, evidence, features, frozen, migration
from tessera.operators.contracts import GroupRule, RowRule, require_none, violations
from tessera.streaming import reports


def test_violations(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", -1), (2, None, None), (None, "b", 3)], "id int, g string, n int")
    rules = [
        RowRule("positive", F.col("n") > 0), RowRule("named", F.col("g").isNotNull()), GroupRule("small", ("g",), F.count(F.lit(1)) < 2),
        GroupRule("once", ("id",), F.count(F.lit(1)) == 1), GroupRule("both", ("id", "g"), F.max("n") > 0),
    ]
    got = {tuple(r) for r in violations(rows, "id", rules).collect()}
    assert got == {("positive", "row", "2", 2), ("named", "row", "2", 1), ("small", "group", "a", 2), ("once", "group", "2", 2), ("both", "group", "2|a", 1), ("both", "group", "2|null", 1)}
    assert violations(rows.limit(0), "id", rules).collect() == []
    assert {r["rule"] for r in violations(rows, "id", rules[:1]).collect()} == {"positive"} and violations(rows, "id", rules[3:4]).count() == 1
    require_none(violations(rows.where("id = 1"), "id", rules))
    with pytest.raises(ValueError, match="named: 1; positive: 1"):
        require_none(violations(rows, "id", rules[:2]))
    with pytest.raises(ValueError):
        violations(rows, "id", [rules[0], rules[0]])
    with pytest.raises(ValueError):
        violations(rows, "id", [])


def test_migration_and_the_way_back(spark):
    rows = spark.createDataFrame([(1, 1, "x", ["a", None, "b", "a"]), (2, 1, None, None), (3, 1, "y", []), (3, 1, "y", ["b"])], "id int, schema_version int, kind string, tags array<string>")
    reviews = spark.createDataFrame([(1, "seen"), (9, "lost")], "id int, decision string")
    steps = [migration.mapped(1, "kind", {"x": "z", "y": "z"}), migration.partitioned_tags(2, "tags", ["a"], "more"), migration.overridden_by_review(3, "id", "kind", reviews, "decision")]
    new = migration.migrated(rows, steps[::-1])
    told = sorted(((r.id, r.schema_version, r.kind, r.tags, r.more.other) for r in new.collect()), key=str)
    assert told == sorted([(1, 4, "seen", ["a", "a"], [None, "b"]), (2, 4, None, None, None), (3, 4, "z", [], []), (3, 4, "z", [], ["b"])], key=str)
    back = migration.reset(new, steps)
    assert back.columns == rows.columns and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="expected version 1"):
        migration.migrated(new.select(rows.columns), steps).collect()
    with pytest.raises(ValueError):
        migration.migrated(rows, [steps[0], steps[2]])


def test_frozen_models(spark, tmp_path):
    from pyspark.ml.feature import Binarizer, Bucketizer

    rows = spark.createDataFrame([(1, 0.2), (2, 0.9), (2, 0.9)], "id int, x double")
    assert frozen.data_fingerprint(rows) == frozen.data_fingerprint(rows.orderBy(F.desc("id")).select("x", "id")) != frozen.data_fingerprint(rows.distinct())
    mark = frozen.fingerprint(rows, {"threshold": 0.5})
    path = f"file://{tmp_path}/model"
    frozen.save(Binarizer(threshold=0.5, inputCol="x", outputCol="y"), path, mark, spark)
    assert [r.y for r in frozen.load(Binarizer, path, mark, spark).transform(rows.orderBy("id")).collect()] == [0.0, 1.0, 1.0]
    for kind, other in ((Binarizer, frozen.fingerprint(rows, {"threshold": 0.6})), (Bucketizer, mark)):
        with pytest.raises(ValueError):
            frozen.load(kind, path, other, spark)


def test_override_caps(spark):
    rows = spark.createDataFrame([("a", "b", "b", 0.9), ("a", "b", "a", 0.7), ("a", "a", "a", 0.99), ("c", "b", "b", 0.75), (None, "b", "b", 0.5)], "cur string, new string, truth string, p double")
    counts = frozen.override_counts(rows, current=F.col("cur"), proposed=F.col("new"), truth=F.col("truth"), confidence=F.col("p"), caps=(0.5, 0.72, 0.95))
    assert {tuple(r) for r in counts.collect()} == {(0.5, 5, 4, 3, 1, 4), (0.72, 5, 2, 2, 0, 4), (0.95, 5, 0, 0, 0, 2)}
    assert frozen.chosen_cap(counts).first()["cap"] == 0.72 and frozen.chosen_cap(counts, most_broken=0.5).first()["cap"] == 0.72


def test_replayed_batches_add_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/reports"
    first = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, x string")
    fault = F.when(F.col("x").isNull(), "no x")
    for batch_id, rows in ((0, first), (1, first.where("id = 2")), (0, first), (1, first.where("id = 2")), (2, first.where("id = 1"))):
        reports.write_batch(rows, batch_id, root, fault, "take in")
    assert sorted((r.id, r.batch_id) for r in reports.reported(spark, root, "rows").collect()) == [(1, 0), (1, 2), (3, 0)]
    assert sorted((r.id, r.fault, r.batch_id) for r in reports.reported(spark, root, "failures").collect()) == [(2, "no x", 0), (2, "no x", 1)]
    assert sorted((r.batch_id, r.status, r.rows, r.failed) for r in reports.reported(spark, root, "progress").collect()) == [(0, "partial", 3, 1), (1, "failed", 1, 1), (2, "done", 1, 0)]
    assert tuple(reports.job_status(spark, root).first()) == ("take in", "done", 3, 5, 2)


def test_gate_features(spark):
    rows = [(1, "m", f"i{k}", k, k == 3, 1.0 / k, None if k == 2 else 0.5) for k in range(1, 13)] + [(1, "o", "i9", 1, True, 0.1, 0.1), (2, "m", "only", 1, None, 0.4, 0.9), (3, "o", "x", 1, False, 0.3, 0.3)]
    frame = spark.createDataFrame(rows, "query int, method string, item string, rank int, relevant boolean, s double, t double")
    found = features.gate_features(frame, main="m", methods=("m", "o"), signals=("s", "t"), aligned={"both": (("s", 0.3), ("t", 0.5))})
    got = {r["query"]: r.asDict() for r in found.collect()}
    assert got[1] == {"query": 1, "rank_m": 3, "rank_o": 1, "top_item": "i1", "max_s": 1.0, "margin_s": 0.5, "max_t": 0.5, "margin_t": 0.0, "both": 2}
    assert got[2] == {"query": 2, "rank_m": None, "rank_o": None, "top_item": "only", "max_s": 0.4, "margin_s": 0.4, "max_t": 0.9, "margin_t": 0.9, "both": 1}
    assert got[3]["top_item"] is None and got[3]["max_s"] == 0.0 and got[3]["both"] == 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert features.snapshot(frame, ("m",), 5).count() == 6


def test_evidence_of_pages(spark):
    cases = [
        ("structured", "编号为AB-12，日期为1999年12月9日", ["no ab 12", "x AB-12"], {"AB-12": "structured_exact", "1999年12月9日": "none"}),
        ("structured", "Dec 9的传真 anti-smoking campaign", ["campain against anti smok-", "ing"], {"anti-smoking": "bound_token_sequence"}),
        ("structured", "smoking anti-smoking", ["smoking anti"], {"anti-smoking": "none"}),
        ("basic", "查找卫念念的登记表，联系电话末位为9", ["卫 念念", "15918555739"], {"卫念念": "exact", "phone_number_ends_with_9": "exact"}),
        ("explicit", "必须包含“Alpha Projects”，并同时包含“Budget”", ["alpha, PROJECTS! budget"], {"Alpha Projects": "exact", "Budget": "exact"}),
        ("explicit", "必须包含“Alpha Projects”，并同时包含“Budget”", None, {"Alpha Projects": "none", "Budget": "none"}),
    ]
    for level, query, lines, want in cases:
        rows = spark.createDataFrame([(query, lines)], "query string, lines array<string>").withColumn("conditions", conditions.literal_conditions(F.col("query"), level))
        got = {e.label: e.match_level for e in evidence.with_evidence(rows, level=level).first().evidence.evidence}
        assert {k: got.get(k) for k in want} == want, query
    none = spark.createDataFrame([(None, ["a"])], "conditions array<struct<label:string,variants:array<string>,source:string>>, lines array<string>")
    assert evidence.with_evidence(none).first().evidence.complete is False
