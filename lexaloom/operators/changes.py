"""Change feeds: snapshot differences, coalescing, task queues, rate windows and caches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Changes of a path that are folded in one row.
RUN = 1024
KINDS = ["Created", "Deleted", "Modified"]


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key and kind (Created, Deleted, Modified) of rows that differ between two snapshots."""
    was = before.select(key, F.xxhash64(*values).alias("was"), F.lit(True).alias("had"))
    now = after.select(key, F.xxhash64(*values).alias("now"), F.lit(True).alias("has"))
    kind = F.when(F.col("had").isNull(), "Created").when(F.col("has").isNull(), "Deleted").when(F.col("was") != F.col("now"), "Modified")
    return was.join(now, key, "full_outer").select(key, kind.alias("kind")).where("kind IS NOT NULL")


def merged_kind(old: Column, new: Column) -> Column:
    """The kind that stands for an earlier (merged) and a later change of one path; 0 is none, others are places in KINDS from 1."""
    return F.when(((old == 1) & (new == 2)) | ((old == 2) & (new == 1)), F.lit(3)).otherwise(new)


def coalesce_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, kind and n of each path's changes, folded in order: each change is merged into what those before it gave.

    A run of RUN changes of a path is folded from every kind that may stand
    before it, and then the runs of a path are: no row holds all changes of a
    path that has very many.
    """
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    runs = changes.select(key, at.alias("at"), code.alias("code")).groupBy(key, F.floor(F.col("at") / RUN).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("at", "code"))).alias("c")
    )
    fold = lambda start: F.aggregate("c", F.lit(start), lambda s, x: merged_kind(s, x["code"]))
    runs = runs.select(key, "run", F.size("c").cast("long").alias("n"), F.array(*[fold(k) for k in range(len(KINDS) + 1)]).alias("to"))
    each = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("run", "to"))).alias("r"), F.sum("n").alias("n"))
    last = F.aggregate("r", F.lit(0), lambda s, x: F.get(x["to"], s))
    return each.select(key, F.get(F.array(*map(F.lit, KINDS)), last - 1).alias("kind"), "n")


def queue_summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert_tasks(queue: DataFrame, incoming: DataFrame, max_retries: int = 3) -> DataFrame:
    """One live task for each path: queue (path, status, retry_count, needs_rerun) after changes (path) come in.

    A task in processing is marked for a rerun; a failed one is pending again below the retry limit; others are reset to pending.
    """
    new = incoming.select("path").distinct().withColumn("came", F.lit(True))
    j = queue.join(new, "path", "full_outer")
    came, status = F.col("came").isNotNull(), F.col("status")
    next_status = (
        F.when(~came | (status == "processing"), status).when((status == "failed") & (F.col("retry_count") >= max_retries), status).otherwise("pending")
    )
    rerun = F.when(came & (status == "processing"), True).otherwise(F.coalesce("needs_rerun", F.lit(False)))
    return j.select("path", next_status.alias("status"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"), rerun.alias("needs_rerun"))


def rate_limited(events: DataFrame, key: str, event_id: str, time_us: str, most: int, window_us: int) -> DataFrame:
    """key, event_id, time_us, n_recent and allowed of each event, in order of time and event_id.

    n_recent counts the events of the key that were allowed in the window
    before; an event is allowed if they are fewer than most, and refused ones do
    not count. A task holds at most ``most`` times of one key.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hits = None, deque()
        for b in batches:
            counts, allowed = [], []
            for own, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (own,) != now:
                    now, hits = (own,), deque()
                while hits and hits[0] < at - window_us:
                    hits.popleft()
                counts.append(len(hits))
                allowed.append(len(hits) < most)
                if allowed[-1]:
                    hits.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(allowed, pa.bool_())], [*b.schema.names, "n_recent", "allowed"])

    rows = events.select(key, F.col(event_id).cast("long").alias(event_id), F.col(time_us).cast("long").alias(time_us))
    rows = rows.repartition(key).sortWithinPartitions(key, time_us, event_id)
    return rows.mapInArrow(run, f"`{key}` {kind}, `{event_id}` long, `{time_us}` long, n_recent long, allowed boolean")


def suppress_own(changes: DataFrame, writes: DataFrame, key: str, ignore_us: int) -> DataFrame:
    """Changes (key, at) that do not follow one of our own writes (key, at) within ignore_us.

    The last write before each change is a running maximum over both, ordered by time: an as-of join in one sort.
    """
    both = changes.select(key, "at", "event_id", F.lit(None).cast("long").alias("wrote")).unionByName(
        writes.select(key, "at", F.lit(None).cast("long").alias("event_id"), F.col("at").alias("wrote"))
    )
    w = Window.partitionBy(key).orderBy("at", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.max("wrote").over(w)).where("event_id IS NOT NULL")
    return seen.where(F.col("last").isNull() | (F.col("at") - F.col("last") > ignore_us)).select(key, "at", "event_id")


def sessions(events: DataFrame, key: str, time_us: str, gap_us: int) -> DataFrame:
    """key, session_start, session_end, n of runs of events with gaps of at most gap_us."""
    w = Window.partitionBy(key).orderBy(time_us, "event_id")
    marked = events.withColumn("new", (F.col(time_us) - F.lag(time_us).over(w) > gap_us).cast("int"))
    run = marked.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return run.groupBy(key, "run").agg(F.min(time_us).alias("session_start"), F.max(time_us).alias("session_end"), F.count(F.lit(1)).alias("n")).drop("run")


def needs_ingest(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Sources (name, hash) that the cache (name, hash) does not hold with the same content."""
    return sources.join(cache.select("name", "hash").distinct(), ["name", "hash"], "left_anti")
