"""Streams that report: results, failures and progress of every batch, each replayable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROGRESS = "batch_id long, phase string, status string, rows long, failed long"


def write_batch(batch: DataFrame, batch_id: int, root: str, fault: Column, phase: str) -> None:
    """One batch into ``root``: rows without a fault, failures with theirs, and a progress row.

    Each of the three has a folder of its own for the batch, which a replay
    writes anew: nothing is added twice, whatever part of the batch was there
    before. Progress comes last, so a batch without it is not done.
    """
    marked = batch.withColumn("fault", fault)
    good, bad = Observation(), Observation()
    place = lambda kind: f"{root}/{kind}/batch_id={batch_id}"
    marked.where("fault is null").drop("fault").observe(good, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(place("rows"))
    marked.where("fault is not null").observe(bad, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(place("failures"))
    n, failed = good.get["n"], bad.get["n"]
    told = batch.sparkSession.createDataFrame([(phase, "failed" if failed and not n else "partial" if failed else "done", n + failed, failed)], PROGRESS.removeprefix("batch_id long, "))
    told.coalesce(1).write.mode("overwrite").parquet(place("progress"))


def start_reporting(stream: DataFrame, root: str, checkpoint: str, fault: Column, phase: str = "ingest") -> StreamingQuery:
    """Starts a stream whose batches are written by ``write_batch``; ``fault`` is null for rows that are fine."""
    write = lambda batch, batch_id: write_batch(batch, batch_id, root, fault, phase)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reported(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``rows``, ``failures`` or ``progress`` of all batches, with their ``batch_id``."""
    return spark.read.parquet(f"{root}/{kind}")


def job_status(spark: SparkSession, root: str) -> DataFrame:
    """One row: the phase and status of the last batch, and totals over all batches."""
    last = F.max_by(F.struct("phase", "status"), "batch_id")
    found = reported(spark, root, "progress").agg(last.alias("last"), F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sum("failed").alias("failed"))
    return found.select("last.phase", "last.status", "batches", "rows", "failed")
