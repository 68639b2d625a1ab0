"""A page registry that is kept by batches: keyed entries as snapshots with a log of changes behind them, in a shared folder.

A batch is one folder, named by its number and written anew if it is run again, and
counts once Spark has marked it as complete; so a batch that was stopped, or one
that is run twice, changes nothing. The state is the latest complete snapshot and
the complete batches behind it: of each key the last change counts. Compaction writes
that state as the next snapshot; batches that it holds are then passed over, also when
they are run again. Nothing is changed in place, so readers never see half a state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.functions import front_matter

UPSERT, REMOVE = "upsert", "remove"
#: Pages that are no entries.
STRUCTURAL = ["index.md", "log.md", "overview.md"]


def entries(pages: DataFrame) -> DataFrame:
    """key, path, title and type of each page (path, content) that is not structural.

    The key is the path below wiki/ without its ending; a page without a title
    field has the last part of its key, one without a type is a query.
    """
    key = F.regexp_replace(F.regexp_replace("path", r"^wiki/", ""), r"(?i)\.md$", "")
    own = pages.select("path", key.alias("key"), front_matter.front_matter(F.coalesce("content", F.lit("")))["fields"].alias("fields"))
    own = own.where((F.col("key") != "") & ~F.element_at(F.split("path", "/"), -1).isin(STRUCTURAL))

    def field(name: str, other: Column) -> Column:
        there = F.schema_of_variant(F.try_variant_get("fields", f"$.{name}", "variant")) == "STRING"
        return F.coalesce(F.when(there, F.nullif(F.trim(F.try_variant_get("fields", f"$.{name}", "string")), F.lit(""))), other)

    return own.select("key", "path", field("title", F.element_at(F.split("key", "/"), -1)).alias("title"), F.lower(field("type", F.lit("query"))).alias("type"))


class Registry:
    """Keyed entries in a folder that driver and executors share.

    schema: the fields of an entry, key among them. Changes have these columns, and
    op (UPSERT or REMOVE) and at, which orders changes of a key within a batch.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "key"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.names = schema.fieldNames()
        own = [T.StructField("_batch", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_op", T.StringType())]
        self.schema = T.StructType([*schema.fields, *own])

    def _complete(self, kind: str) -> list[int]:
        """The numbers of the complete folders of a kind, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{kind}/{number:012d}")

    def version(self) -> int:
        """The last batch that the latest snapshot holds; -1 without a snapshot."""
        return max(self._complete("snapshot"), default=-1)

    def apply(self, batch: int, changes: DataFrame) -> None:
        """Write one batch; of each key its last change counts. A batch that a snapshot holds already is passed over."""
        if batch <= self.version():
            return
        rows = changes.select(*self.names, F.lit(batch).cast("long").alias("_batch"), F.col("at").cast("long").alias("_at"), F.col("op").alias("_op"))
        self._last(rows.where(F.col(self.key).isNotNull())).write.mode("overwrite").parquet(f"{self.folder}/log/{batch:012d}")

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of each key the last change, by batch, place and, if those are equal, the removal."""
        order = F.struct("_batch", F.coalesce("_at", F.lit(-(1 << 63))), (F.col("_op") == REMOVE).alias("gone"))
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.fieldNames()), order).alias("last"))
        return last.select("last.*")

    def _changes(self) -> DataFrame:
        at = self.version()
        parts = [self._read("snapshot", at)] if at >= 0 else []
        parts += [self._read("log", b) for b in self._complete("log") if b > at]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        """The entries as they are after all complete batches."""
        return self._last(self._changes()).where(F.col("_op") == UPSERT).select(*self.names)

    def compact(self) -> int:
        """Write the state as a snapshot; the number of the last batch that it holds."""
        upto = max([self.version(), *self._complete("log")])
        if upto > self.version():
            live = self._last(self._changes()).where(F.col("_op") == UPSERT)
            live.write.mode("overwrite").parquet(f"{self.folder}/snapshot/{upto:012d}")
        return upto

    def rebuild(self, rows: DataFrame, batch: int) -> None:
        """Make rows (entries) the whole state, as of a batch; earlier batches no longer count."""
        whole = rows.select(*self.names, F.lit(batch).cast("long").alias("_batch"), F.lit(0).cast("long").alias("_at"), F.lit(UPSERT).alias("_op"))
        self._last(whole).write.mode("overwrite").parquet(f"{self.folder}/snapshot/{batch:012d}")
