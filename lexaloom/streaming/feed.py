"""Structured Streaming over change feeds: windows, deduplication and per-path state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over an event table's files, with ts as a timestamp."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(batch.schema)
    rows = stream.parquet(path) if len(batch.inputFiles()) > 1 else stream.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def once(events: DataFrame, late: str, *keys: str) -> DataFrame:
    """Events without those that repeat the keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its rows.

    Complete results are a table in the warehouse, one version for each batch;
    the last one counts. Other rows lie in a folder for each batch, which a batch
    that is run again overwrites, so no row comes twice.
    """
    name = f"stream_{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder, seen = f"{base}/{name}-rows", []

    def save(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").saveAsTable(name)
        else:
            batch.write.mode("overwrite").parquet(f"{folder}/{number:010d}")
            seen.append(number)

    query = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/{name}-state").foreachBatch(save).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.table(name)
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(folder) if seen else spark.createDataFrame([], rows.schema)


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """hour (start), event_type, n and value of an event table, by a stream."""
    counts = windowed(read_events(spark, path), "1 hour", "1 day", "event_type")
    return run_to_table(spark, counts.select(F.col("window.start").alias("hour"), "event_type", "n", "value"), "complete")


TASK_DDL = "path string, status string, retry_count int, needs_rerun boolean, n_changes long"


def task_states(changes: DataFrame, max_retries: int = 3) -> DataFrame:
    """One live task for each path of a stream of changes (path, status, ts).

    status is `changed` for a change of the file, else what a worker reports:
    processing, failed or done. A change during processing marks a rerun; a
    failure leads back to pending until max_retries.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries, rerun, n = state.get if state.exists else ("pending", 0, False, 0)
        for came in (s for f in frames for s in f.sort_values("ts")["status"]):
            n += 1
            if came == "changed":
                if status == "processing":
                    rerun = True
                elif status != "failed" or retries < max_retries:
                    status = "pending"
            elif came == "failed":
                retries += 1
                status = "pending" if retries < max_retries else "failed"
            elif came == "done":
                status, rerun = ("pending", False) if rerun else ("done", False)
            else:
                status = came
        state.update((status, retries, rerun, n))
        yield pd.DataFrame([(*key, status, retries, rerun, n)], columns=["path", "status", "retry_count", "needs_rerun", "n_changes"])

    return changes.groupBy("path").applyInPandasWithState(
        step, TASK_DDL, "status string, retry_count int, needs_rerun boolean, n_changes long", "update", GroupStateTimeout.NoTimeout
    )
