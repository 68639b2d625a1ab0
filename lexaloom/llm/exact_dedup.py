"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes meets a condition, so
equal stretches of different texts give equal chunks. The chunk store lists
each distinct chunk once: by SHA-256 digest and length, checked against an
independent 64-bit fingerprint, with a number of its own as identifier. A text
is then its recipe, the ordered list of its chunks' identifiers, and texts are
equal exactly when their recipes are. Long texts never leave the task that read
them: of a chunk of about 2 KB, 56 bytes are shuffled to find its identifier,
and 16 to put it in its recipe.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import batch, fresh, materialize, raw, slices, tidied

#: Cut points: a boundary where the low MASK_BITS bits of the rolling hash are 0, chunks of MIN to MAX bytes.
MASK_BITS, MIN_BYTES, MAX_BYTES = 11, 512, 16384

_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> list[int]:
    """The ends of data's chunks; they depend on content only. Empty data has one empty chunk."""
    n = len(data)
    if n <= MIN_BYTES:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:  # h[i] becomes the sum of the last 32 bytes' values, each shifted by its distance
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    marks = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    ends, start, k = [], 0, 0
    while n - start > MIN_BYTES:
        k = int(np.searchsorted(marks, start + MIN_BYTES, "left"))
        end = min(int(marks[k]) if k < len(marks) else n, start + MAX_BYTES, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    """data's chunks, in order."""
    ends = cut_points(data)
    return [data[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)]


_CUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())),
        ("prints", pa.list_(pa.int64())),
    ]
)
_CUT_DDL = "doc_id long, text_sha256 string, digests array<binary>, sizes array<int>, prints array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        shas, digests, sizes, prints = [], [], [], []
        for text in raw(b.column(1)):
            own = chunks(text or b"")
            sha = hashlib.sha256(text or b"")
            shas.append(sha.hexdigest())
            digests.append([sha.digest()] if len(own) == 1 else [hashlib.sha256(c).digest() for c in own])
            sizes.append([len(c) for c in own])
            prints.append([xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in own])
        yield batch(_CUT, b.column(0), shas, digests, sizes, prints)


def cut_texts(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text_sha256 and the digests, sizes and prints of the chunks of each row's text; null counts as empty."""
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(_cut), _CUT_DDL)
    return materialize(cut.withColumn("row", F.monotonically_increasing_id()), "chunked")


def placed_chunks(cut: DataFrame) -> DataFrame:
    """row, at (place in the text), digest, n_bytes and print of each chunk."""
    each = F.posexplode(F.arrays_zip("digests", "sizes", "prints")).alias("at", "c")
    return cut.select("row", each).select("row", "at", F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n_bytes"), F.col("c.prints").alias("print"))


def chunk_store(placed: DataFrame) -> DataFrame:
    """digest, n_bytes, n_places, verified and chunk_id of each distinct chunk.

    ``verified`` is false for a digest that occurs with several lengths or
    fingerprints: then one digest stands for different chunks.
    """
    held = placed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_places"), F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("most"), F.min("print").alias("print"), F.max("print").alias("last")
    )
    same = (F.col("n_bytes") == F.col("most")) & (F.col("print") == F.col("last"))
    store = held.select("digest", "n_bytes", "n_places", same.alias("verified"), F.monotonically_increasing_id().alias("chunk_id"))
    return materialize(store, "chunk-store")


def recipes(cut: DataFrame) -> DataFrame:
    """row and recipe (array of chunk ids in order) of each row of cut_texts(); a chunk that is not verified is an error."""
    placed = placed_chunks(cut)
    ids = chunk_store(placed).select("digest", F.expr("if(verified, chunk_id, raise_error('a digest stands for different chunks'))").alias("chunk_id"))
    found = materialize(placed.select("row", "at", "digest").join(ids, "digest").select("row", "at", "chunk_id"), "chunk-ids")
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))).alias("c"))
    return listed.select("row", F.col("c.chunk_id").alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of a group is kept. Null texts equal empty
    ones. Rows that repeat a doc_id with the same text each count in group_size
    and all carry kept; an empty table gives an empty result. Other columns are
    not read. Counts are pre-aggregated on the map side, and the joins on chunk
    and recipe can be split by adaptive execution when one is very common.
    """
    cut = cut_texts(docs)
    made = materialize(cut.select("row", "doc_id", "text_sha256").join(recipes(cut), "row").drop("row"), "recipes")
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    many = materialize(groups.where("group_size > 1"), "groups")
    joined = made.join(many, "recipe", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.equal_null(F.col("doc_id"), keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id has; columns as given.

    Of rows that repeat both doc_id and text one stays.
    """
    names = docs.columns
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    sha = fresh(names, "_sha")
    own = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    on = own["doc_id"].eqNullSafe(kept["_kept_id"]) & (own[sha] == kept["_kept_sha"])
    return own.join(kept, on, "left_semi").dropDuplicates(["doc_id", sha]).select(*names)
