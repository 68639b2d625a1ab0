"""Token-id shards with minimal perfect hash indexes.

A store is one Parquet folder. Each row is a shard: the ids of consecutive
documents in ascending doc_id order as one raw payload of little-endian
unsigned integers (2 bytes wide where the vocabulary allows it, else 4), and an
index over the shard's documents. The index is a minimal perfect hash: keys
fall into groups, and each group has a seed under which its keys take slots of
their own, so that n keys fill exactly n slots. A slot stores a fingerprint of
its key and the place of the ids, so a lookup is two hashes, one comparison and
one slice, and an absent key is told apart with probability 1 - 2^-32.
Shards follow each other in the order of doc_id; the first and last key of a
shard are columns with Parquet statistics, so a lookup by key reads one row group.

Texts are encoded where they are read. Their ids, 2 or 4 bytes each, are written
once and range-partitioned by doc_id and row, so rows of one doc_id, however
many, are spread over tasks and shards too; a shard is bounded by ``shard_ids``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import TOGETHER, encoder
from .work import batch, materialize, tidied, work_path

#: Ids in a shard at most, if it has more than one document.
SHARD_IDS = 1 << 20

_U64 = np.uint64


def _mix(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(_U64) + np.asarray(seed, _U64) * _U64(0x9E3779B97F4A7C15) + _U64(0x632BE59BD9B4E019)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1) >> _U64(32)).astype(np.uint32)


def build_mph(keys: np.ndarray, per_group: int = 4) -> np.ndarray:
    """A seed for each group of distinct 64-bit keys, largest groups placed first."""
    n = len(keys)
    groups = max(1, -(-n // per_group))
    of = (_mix(keys, 0) % _U64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=groups)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    seeds = np.zeros(groups, np.uint32)
    taken = np.zeros(n, bool)
    trial = np.arange(2, 34, dtype=np.int64)
    for g in np.argsort(-counts, kind="stable"):
        size = counts[g]
        if not size:
            break
        own = keys[order[starts[g] : starts[g] + size]]
        first = 0
        while True:
            tried = trial + first
            slots = (_mix(own[None, :], tried[:, None]) % _U64(n)).astype(np.int64)
            fits = ~taken[slots].any(axis=1)
            if size > 1:
                ordered = np.sort(slots, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                seeds[g] = tried[k]
                taken[slots[k]] = True
                break
            first += len(trial)
    return seeds


def slots_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key; of a key that was not built in, some slot."""
    of = (_mix(keys, 0) % _U64(len(seeds))).astype(np.int64)
    return (_mix(keys, seeds[of]) % _U64(n)).astype(np.int64)


_SHARD = pa.schema(
    [
        ("shard", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
        ("keys", pa.binary()), ("seeds", pa.binary()), ("prints", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary()),
        ("payload", pa.binary()),
    ]
)
SHARD_DDL = (
    "shard long, first_key long, last_key long, n_docs long, n_ids long, width int, "
    "keys binary, seeds binary, prints binary, offsets binary, lengths binary, payload binary"
)


def shard_row(shard: int, keys: list[int | None], ids: list[bytes], width: int) -> list:
    """A shard of documents in order; ids are width bytes wide. A key that repeats has one slot, with all its ids.

    Documents without a key make shards of their own, whose first and last key are null; no lookup meets them.
    """
    lengths = np.array([len(x) // width for x in ids], np.int64)
    k = np.zeros(len(keys), np.int64) if keys[0] is None else np.array(keys, np.int64)
    distinct, first = np.unique(k, return_index=True)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    seeds = build_mph(distinct.view(_U64))
    slots = slots_of(distinct.view(_U64), seeds, len(distinct))
    at, size, prints = np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<u4")
    at[slots] = offsets[first]
    size[slots] = np.add.reduceat(lengths, first)
    prints[slots] = fingerprints(distinct.view(_U64))
    own = np.stack((k, lengths), 1).astype("<i8").tobytes()
    head = [shard, keys[0], keys[-1], len(keys), int(lengths.sum()), width]
    return [*head, own, seeds.astype("<u4").tobytes(), prints.tobytes(), at.tobytes(), size.tobytes(), b"".join(ids)]


def parts(b: pa.RecordBatch, most: int = TOGETHER) -> Iterator[tuple[list[int | None], list[str]]]:
    """Keys and texts (null as empty) of a batch, in parts of about most characters."""
    keys, texts, held = [], [], 0
    for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        text = text.as_py() or ""
        if keys and held + len(text) > most:
            yield keys, texts
            keys, texts, held = [], [], 0
        keys.append(key)
        texts.append(text)
        held += len(text)
    if keys:
        yield keys, texts


_ENCODED = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
#: Bytes of ids in a batch of encoded documents.
HELD_BYTES = 8_000_000


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if max(enc.size - 1, end_id) < 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        for b in batches:
            for keys, texts in parts(b):
                ids = [x.astype(f"<u{width}").tobytes() + end for x in enc.encode(texts)]
                first = held = 0
                for at, x in enumerate(ids):
                    if at > first and held + len(x) > HELD_BYTES:
                        yield batch(_ENCODED, keys[first:at], [width] * (at - first), ids[first:at])
                        first, held = at, 0
                    held += len(x)
                yield batch(_ENCODED, keys[first:], [width] * (len(keys) - first), ids[first:])

    return run


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, width and ids (little-endian, width bytes each, end_id last) of every whole text; a null text counts as empty."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidied(_encode(tokenizer, end_id)), "doc_id long, width int, ids binary")


def _shards(shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys: list[int] = []
        ids: list[bytes] = []
        held = width = 0

        def made():
            return batch(_SHARD, *[[x] for x in shard_row(number, keys, ids, width)])

        for b in batches:
            for key, width, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if keys and (held + len(x) // width > shard_ids or (key is None) != (keys[-1] is None)):
                    yield made()
                    number += 1
                    keys, ids, held = [], [], 0
                keys.append(key)
                ids.append(x)
                held += len(x) // width
        if keys:
            yield made()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append end_id to each, and write the shards in ascending doc_id order.

    Null texts count as empty. Rows without a doc_id have no key and stand after
    all others. Rows that repeat a doc_id follow each other, in no set order; one
    slot of each shard that holds any covers them.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(encoded(keyed, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "encoded")
    order = F.asc_nulls_last("doc_id"), F.asc("row")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "width", "ids")
    ranged.mapInArrow(tidied(_shards(shard_ids)), SHARD_DDL).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store."""
    return spark.read.schema(SHARD_DDL).parquet(path)


class Shard:
    """Keyed access to one shard row."""

    def __init__(self, row):
        self.seeds = np.frombuffer(row["seeds"], "<u4")
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.payload = np.frombuffer(row["payload"], f"<u{row['width']}")

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key's ids; length -1 for an absent key."""
        k = keys.astype(np.int64).view(_U64)
        if not len(self.prints):
            return np.zeros(len(k), np.int64), np.full(len(k), -1)
        slots = slots_of(k, self.seeds, len(self.prints))
        there = self.prints[slots] == fingerprints(k)
        return self.offsets[slots], np.where(there, self.lengths[slots], -1)

    def ids(self, key: int) -> np.ndarray | None:
        """The ids of one document, or None."""
        at, n = self.places(np.array([key]))
        return None if n[0] < 0 else self.payload[at[0] : at[0] + n[0]].astype("<u4")


_LOOKED = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document of each shard, found by key."""
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(i)[k].as_py() for i, n in enumerate(b.schema.names)}
            shard, own = Shard(row), np.frombuffer(row["keys"], "<i8").reshape(-1, 2)
            key, length = own[:, 0], own[:, 1]
            at, found = shard.places(key)
            before = np.concatenate(([0], np.cumsum(length)[:-1]))
            first = np.searchsorted(key, key, "left")
            at = at + before - before[first]  # rows that repeat a key follow each other in its slice
            if (found < length).any() or (at != before).any():
                raise ValueError("an index entry does not match its shard")
            wide = shard.payload.astype("<u4")
            crcs = [zlib.crc32(wide[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            key = pa.nulls(len(key), pa.int64()) if row["first_key"] is None else key
            yield batch(_LOOKED, key, np.full(len(length), row["shard"]), at, length, crcs)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from a store through its indexes.

    Starts are running sums over shards: shards are summed within the task that
    wrote them in parallel, and only one total for each such task goes through
    a single window.
    """
    shards = read_store(spark, path).select("shard", F.shiftright("shard", 32).alias("task"), "n_ids")
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("task_ids"))
    tasks = tasks.select("task", F.coalesce(F.sum("task_ids").over(_running("task")), F.lit(0)).alias("task_start"))
    inner = F.sum("n_ids").over(_running("shard", "task"))
    starts = shards.withColumn("inner", F.coalesce(inner, F.lit(0))).join(tasks, "task")
    starts = starts.select("shard", (F.col("task_start") + F.col("inner")).alias("base"))
    found = read_store(spark, path).mapInArrow(_digests, "doc_id long, shard long, shard_start long, n_tokens long, ids_crc32 long")
    return found.join(starts, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def _running(order: str, *by: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def lookup(spark: SparkSession, path: str, key: int) -> list[int] | None:
    """The ids of one document, or None: a shard row is read by the statistics of its key range.

    If rows repeat the key, their ids follow each other; they may lie in several shards.
    """
    rows = read_store(spark, path).where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard").toLocalIterator()
    found = [ids for ids in (Shard(row).ids(key) for row in rows) if ids is not None]
    return np.concatenate(found).tolist() if found else None


def store_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write docs to a new store in the shared folder and report what it holds."""
    path = work_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id, shard_ids)
    return digests(docs.sparkSession, path)
