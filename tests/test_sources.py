import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, schemas


def test_json_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"item_id": "a", "search_enabled": false}\n\n{"item_id": "b"}\n')
    rows = readers.json_lines(spark, str(path), schemas.MANIFEST)
    assert sorted(r.item_id for r in rows.collect()) == ["a", "b"]
    assert [r.item_id for r in readers.enabled_items(rows).collect()] == ["b"]
    path.write_text('{"item_id": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        readers.json_lines(spark, str(path), schemas.MANIFEST).collect()
    bad = readers.json_lines(spark, str(path), schemas.MANIFEST, strict=False).cache()
    assert bad.where("_corrupt_record is not null").count() == 1


def test_lines_and_corrections(spark):
    base = spark.createDataFrame([("a", [" x ", "", "y"], [0.9, 0.9, 0.1]), ("b", ["z"], [0.5])], schemas.OCR_PAYLOAD)
    assert [(r.item_id, r.line, r.text) for r in readers.readable_lines(base).orderBy("item_id").collect()] == [("a", 0, "x"), ("b", 0, "z")]
    fixed = spark.createDataFrame([("a", ["new"], [1.0])], schemas.OCR_PAYLOAD)
    got = {r.item_id: (r.text, r.corrected) for r in readers.corrected_text(base, fixed).collect()}
    assert got == {"a": ("new", True), "b": ("z", False)}
    uneven = spark.createDataFrame([("a", ["x"], [0.1, 0.2])], schemas.OCR_PAYLOAD)
    with pytest.raises(Exception, match="differ in length"):
        readers.readable_lines(uneven).collect()


def test_files_scores_and_publishing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"same")
    (tmp_path / "in" / "b.txt").write_bytes(b"same")
    files = readers.whole_files(spark, str(tmp_path / "in"), "*.txt")
    assert files.select("item_id").distinct().count() == 1 and readers.directory_manifest(files).count() == 2
    payload = spark.createDataFrame([("q", "text", "r", ["a", "b"], [0.1, 0.2])], schemas.SCORES)
    scores = readers.long_scores(payload)
    assert sorted((r["item"], r.score) for r in scores.collect()) == [("a", 0.1), ("b", 0.2)]
    root = str(tmp_path / "lib")
    readers.publish({"scores": scores}, root, "v1")
    readers.publish({"scores": scores.where("item = 'a'")}, root, "v2")
    assert readers.published(spark, root, "scores").count() == 1
    readers.write_json_lines(scores.coalesce(1), str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("part-*")).read_text().splitlines()[0]
    assert list(json.loads(line)) == ["branch", "item", "query", "score"]
    flags = spark.createDataFrame([("True",), ("0",), ("?",)], "v string").select(readers.boolean(F.col("v")).alias("b"))
    assert [r.b for r in flags.collect()] == [True, False, None]
