"""Session factory and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lexaloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC times.

    Nothing here depends on the data's size: partition counts come from the
    cluster's own settings, and adaptive execution coalesces or splits them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, spread: int = False) -> DataFrame:
    """One table of a dataset folder; works for any path that Spark can read.

    spread deals out the rows of a table that would be read in fewer tasks than
    so many times the cluster's cores, for operators whose work on a row is
    large. Large tables are split by the reader and stay as they are. Narrow
    rows of which large work is made want more than one: the reader makes
    splits by bytes, but only those with the middle of a row group have rows.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spread * spark.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


#: Rows that a task of a step that is dealt out by rows sorts or groups.
TASK_ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks a step over so many rows wants, or None where those that the session makes anyway have fewer rows each."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by keys in so many tasks, which joins and groups by these keys then keep; df itself where tasks is None."""
    return df.repartition(tasks, *keys) if tasks else df


def _shared_folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="lexaloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session, whose executors are the driver's own process, may go without that setting.
    """
    _shared_folder(df)
    return df.checkpoint()


#: Spark's setting that removes a query's shuffle files when it ends; else they stay until the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_statistics(df: DataFrame) -> DataFrame:
    """df written to that folder and read again, for loops without a fixed end.

    A checkpoint keeps the size that its plan was estimated at; over many rounds of joins the estimate outgrows any number.
    Once the table is written, the shuffle files that it was made of go, as nothing reads them again.
    """
    path, conf = f"{_shared_folder(df)}/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(df: DataFrame, name: str) -> str:
    """A path in that folder that nothing else uses."""
    return f"{_shared_folder(df)}/{name}-{uuid.uuid4().hex}"
