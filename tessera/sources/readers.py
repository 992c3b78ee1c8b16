"""Readers and writers for files: JSON lines, CSV, whole files, page texts, score payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON lines under a schema; strict reading fails on a bad line, lenient reading keeps it in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV; a byte-order mark and surrounding blanks are dropped."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("enforceSchema", False).csv(path)


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, item_id, size, content)`` of every file below ``path``, named by its content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.concat(F.lit("user_"), F.substring(F.sha2("content", 256), 1, 12))
    return rows.select("path", name.alias("item_id"), F.col("length").alias("size"), "content")


def directory_manifest(files: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of each file."""
    return files.select("path", "size", F.sha2("content", 256).alias("sha256"))


def enabled_items(manifest: DataFrame) -> DataFrame:
    """Manifest rows that search may return; a missing flag means yes."""
    return manifest.where(F.coalesce("search_enabled", F.lit(True)))


def readable_lines(payload: DataFrame, minimum: float = 0.35) -> DataFrame:
    """``(item_id, line, text, confidence)`` of recognised lines above a confidence; unequal array lengths fail."""
    same = F.assert_true(F.size("rec_texts") == F.size("rec_scores"), F.lit("texts and scores differ in length"))
    rows = payload.where(F.coalesce(same.cast("string"), F.lit("")) == "").select("item_id", F.posexplode(F.arrays_zip("rec_texts", "rec_scores")).alias("line", "x"))
    rows = rows.select("item_id", "line", F.trim("x.rec_texts").alias("text"), F.col("x.rec_scores").alias("confidence"))
    return rows.where((F.col("text") != "") & (F.col("confidence") >= minimum))


def corrected_text(base: DataFrame, corrections: DataFrame) -> DataFrame:
    """Text per item, human corrections before recognised lines."""
    new = corrections.select("item_id", F.array_join("rec_texts", "\n").alias("_text"))
    rows = base.select("item_id", F.array_join("rec_texts", "\n").alias("text")).join(new, "item_id", "full")
    return rows.select("item_id", F.coalesce("_text", "text").alias("text"), F.col("_text").isNotNull().alias("corrected"))


def long_scores(payload: DataFrame) -> DataFrame:
    """``(query, branch, item, score)`` from parallel arrays."""
    rows = payload.select("query", "branch", F.explode(F.arrays_zip("item_ids", "scores")).alias("x"))
    return rows.select("query", "branch", F.col("x.item_ids").alias("item"), F.col("x.scores").alias("score"))


def boolean(value: Column) -> Column:
    """Spelled-out booleans; anything else is null."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n", ""), False)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with keys in order; the commit protocol makes the folder appear whole."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def publish(tables: dict[str, DataFrame], root: str, version: str) -> DataFrame:
    """Writes several tables under a new version and then one pointer row, so readers see all or none."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    pointer = spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return pointer


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as of the latest published version."""
    latest = spark.read.parquet(f"{root}/_published").orderBy(F.col("at").desc(), F.col("version").desc()).first()
    return spark.read.parquet(f"{root}/{latest['version']}/{name}")
