"""Working tables in the shared folder, and raw text access inside tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session, whose executors are the driver's own process, may go
    without the setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="lexaloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers, and rows with a whole text, for which a step gets a task of its own.
TASK_ROWS, TASK_TEXTS = 1 << 16, 1 << 12


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df, which has at most so many rows, in no more partitions than that takes; four a core stay.

    A step on few rows then costs no task, file and call of Python for each
    shuffle partition, where adaptive execution may not join small ones. The
    bound grows with the rows, so large steps keep their partitions.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def materialize(df: DataFrame, name: str, rows: int | None = None, each: int = TASK_ROWS) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that survive a lost executor.

    rows: how many rows df has at most, if that is known (see few).
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    (df if rows is None else few(df, rows, each)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(names: list[str], name: str) -> str:
    """name, with underscores before it until it is not among names (ignoring case)."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the given columns (lists, arrays or Arrow arrays)."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def tidy() -> None:
    """Give memory that Arrow's pool and the C library hold in reserve back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches after which the worker, that later stages use again, is small again."""

    @functools.wraps(run)
    def made(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return made


#: Rows whose texts a task holds as Python values at a time.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: what a task makes of them stays small however many rows Spark puts in a batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Bits of a sieve for each key, and the bits that are broadcast at most (32 MB).
SIEVE_BITS_EACH, SIEVE_BITS_MOST = 12, 1 << 28


def sieve(keys: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test that every key of a long column passes and about 98 percent of other numbers fail: a Bloom filter.

    Two of at least SIEVE_BITS_EACH bits stand for each key counted. If that
    takes more than SIEVE_BITS_MOST bits, nothing is gathered or broadcast and
    everything passes: the exact join that must follow the test then does all
    the work, in a shuffle of its own.
    """
    need = SIEVE_BITS_EACH * keys.count()
    if need > SIEVE_BITS_MOST:
        return lambda c: F.lit(True)
    size = max(1 << 16, 1 << (need - 1).bit_length() if need else 0)
    spot = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(size))
    bits = keys.select(F.explode(F.array(spot(F.col(name), 1), spot(F.col(name), 2))).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = bits.agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def there(first: pd.Series, second: pd.Series) -> pd.Series:
        x, y = first.to_numpy(), second.to_numpy()
        found = (shared.value[x >> 6] >> (x & 63)) & (shared.value[y >> 6] >> (y & 63)) & 1
        return pd.Series(found.astype(bool))

    return lambda c: there(spot(c, 1), spot(c, 2))
