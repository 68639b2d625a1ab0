"""Resumable ingestion of a folder of files: what is known of each file decides whether it is read again.

A batch begins with its manifest, the files that it takes with their sizes and times,
then the texts of those files are written, and last what is known of them goes to the
registry. Each is a folder of the batch's number that counts once it is complete. A run
that was stopped goes on with the manifest that has no registry batch yet, so it gives
the rows that it would have given. Files whose size and time are as known are not
opened; files that were only touched are opened, but their text stays as it was.
Files above ``most_bytes`` are known by size and time alone. A file that cannot be
read is tried again in later runs, ``tries`` times at most, until it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaloom.sources import office
from lexaloom.sources.pages import file_text
from lexaloom.streaming.registry import REMOVE, UPSERT, Registry

KNOWN = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("hash", T.StringType()),
    T.StructField("tried", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("texts", T.LongType()),
])
MANIFEST = "path string, action string, size long, mtime long, old_hash string, old_texts long, tried int"


def plan(scan: DataFrame, known: DataFrame, tries: int = 3, most_bytes: int = 1 << 28) -> DataFrame:
    """path, action (read, retry, large, gone or same), size, mtime, old_hash, old_texts and tried of each file.

    scan: path, size, mtime; known: rows of KNOWN. A failed file that is as it was is retried up to tries times.
    """
    own = known.select("path", *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "hash", "texts")), F.col("tried"), F.col("error"), F.lit(True).alias("had"))
    both = scan.select("path", "size", "mtime", F.lit(True).alias("has")).join(own, "path", "full_outer")
    same = F.col("had") & F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    action = (
        F.when(F.col("has").isNull(), "gone").when(same & F.col("error").isNotNull() & (F.col("tried") < tries), "retry").when(same, "same")
        .when(F.col("size") > most_bytes, "large").otherwise("read")
    )
    tried = F.when(action == "retry", F.col("tried")).otherwise(0)
    return both.select("path", action.alias("action"), "size", "mtime", "old_hash", "old_texts", tried.alias("tried"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, hash, text (null where the hash is the old one) and error of files that were opened."""
    import hashlib

    for b in batches:
        rows = []
        for path, data, size, old in zip(b["path"], b["content"], b["size"], b["old_hash"], strict=True):
            data = bytes(data)
            digest, text, error = hashlib.sha256(data).hexdigest(), None, None
            if len(data) != size:
                digest, error = None, "changed while it was read"
            elif digest != old:
                try:
                    text = file_text(path, data)
                    if not text and data and path.rsplit(".", 1)[-1].lower() in office.KINDS:
                        raise ValueError("no text, or no archive")
                except Exception as e:  # any fault of a parser is this file's, not the batch's
                    digest, text, error = None, None, f"{type(e).__name__}: {e}"[:500]
            rows.append((path, digest, text, error))
        yield pd.DataFrame(rows, columns=["path", "hash", "text", "error"])


class Ingestion:
    """Texts of the files below source, kept in folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, source: str, folder: str, tries: int = 3, most_bytes: int = 1 << 28, most_files: int = 10_000):
        self.spark, self.source, self.folder = spark, source, folder.rstrip("/")
        self.tries, self.most_bytes, self.most_files = tries, most_bytes, most_files
        self.known = Registry(spark, self.folder, KNOWN, "path")

    def scan(self) -> DataFrame:
        """path, size and mtime (milliseconds) of the files that are there; none is opened."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.source)
        return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))

    def _done(self) -> int:
        return max([self.known.version(), *self.known._complete("log")])

    def run(self, kinds: tuple[str, ...] = ("read", "retry", "large", "gone")) -> int:
        """Take one batch of files with these actions; how many it took. What an earlier run has begun is ended first."""
        batch = self._done() + 1
        at = f"{self.folder}/manifest/{batch:012d}"
        begun = batch in self.known._complete("manifest") and not self.spark.read.schema(MANIFEST).parquet(at).isEmpty()
        if not begun:
            work = plan(self.scan(), self.known.state(), self.tries, self.most_bytes).where(F.col("action").isin(*kinds))
            work.orderBy("path").limit(self.most_files).write.mode("overwrite").parquet(at)
        manifest = self.spark.read.schema(MANIFEST).parquet(at)
        paths = [r["path"] for r in manifest.where("action IN ('read', 'retry')").select("path").collect()]  # most_files at most
        n = manifest.count()
        if not n:
            return 0
        self._texts(manifest, paths).write.mode("overwrite").parquet(f"{self.folder}/texts/{batch:012d}")
        read = self.spark.read.schema("path string, hash string, text string, error string").parquet(f"{self.folder}/texts/{batch:012d}")
        rows = manifest.join(read.select("path", "hash", "error", F.col("text").isNotNull().alias("new")), "path", "left")
        opened = F.col("action").isin("read", "retry")
        error = F.when(opened, F.when(F.col("hash").isNull(), F.coalesce("error", F.lit("gone while it was read"))))
        self.known.apply(batch, rows.select(
            "path", "size", "mtime", F.when(F.col("action") == "large", F.concat_ws(" ", F.lit("stat"), "size", "mtime")).otherwise(F.col("hash")).alias("hash"),
            F.when(opened & error.isNotNull(), F.col("tried") + 1).otherwise(0).alias("tried"), error.alias("error"),
            F.when(F.col("new"), F.lit(batch).cast("long")).when(opened & error.isNull(), F.col("old_texts")).alias("texts"),
            F.when(F.col("action") == "gone", REMOVE).otherwise(UPSERT).alias("op"), F.lit(0).cast("long").alias("at"),
        ))
        return n

    def _texts(self, manifest: DataFrame, paths: list[str]) -> DataFrame:
        ddl = "path string, hash string, text string, error string"
        there = self.scan().join(F.broadcast(manifest.select("path")), "path", "left_semi").select("path").collect() if paths else []
        kept = sorted({r["path"] for r in there} & set(paths))
        if not kept:
            return self.spark.createDataFrame([], ddl)
        files = self.spark.read.format("binaryFile").load(kept).select("path", "content")
        return files.join(manifest.select("path", "size", "old_hash"), "path").mapInPandas(_read, ddl)

    def run_all(self) -> int:
        """Try files again that failed in earlier calls (one batch of them), then take batches until nothing is left; how many files they took."""
        total = self.run(("retry",))
        while True:
            n = self.run(("read", "large", "gone"))
            total += n
            if n < self.most_files:
                return total

    def texts(self) -> DataFrame:
        """path, text and hash of every file that has a text, as it is now."""
        own = self.known.state().where("texts IS NOT NULL").select("path", "hash", F.col("texts").alias("batch"))
        batches = [r["batch"] for r in own.select("batch").distinct().collect()]  # one number for each run
        if not batches:
            return self.spark.createDataFrame([], "path string, text string, hash string")
        parts = [self.spark.read.schema("path string, text string").parquet(f"{self.folder}/texts/{b:012d}").withColumn("batch", F.lit(b).cast("long")) for b in sorted(batches)]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found.where("text IS NOT NULL").join(own, ["path", "batch"]).select("path", "text", "hash")
