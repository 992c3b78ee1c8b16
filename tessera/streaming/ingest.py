"""Idempotent incremental ingest as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.workspace import shared_root


def ingest_stream(spark: SparkSession, path: str, key: str, target: str, checkpoint: str, *, watermark: tuple[str, str] | None = None):
    """Starts a stream that appends rows with new keys to ``target``.

    Without a watermark the keys seen stay in the state store for good, which
    is what exactly-once ingest by key means; with one, keys older than the
    delay leave the state.
    """
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    else:
        rows = rows.dropDuplicates([key])
    sink = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start()


def ingested_once(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What ``path`` (a file or a folder) holds, taken in by one run of the stream."""
    base = f"{shared_root(spark)}/tessera/ingest-{uuid.uuid4().hex}"
    parent, _, name = path.rpartition("/")
    query = ingest_stream(spark, f"{parent}/{name[:-1]}[{name[-1]}]", key, f"{base}/rows", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/rows")
