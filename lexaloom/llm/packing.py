"""Packing documents into fixed-length sequences with a distributed grouping genetic algorithm.

A document longer than a sequence is cut so that every piece but the first is
full; full pieces are sequences of their own, and the one shorter piece is an
item to pack. Items are dealt by hash into blocks of bounded size, and several
islands evolve packings of each block. An individual is a list of whole bins
(the groups). Crossover injects well-filled bins of one parent into the other,
drops the bins that hold an injected item again, and places the displaced
documents by best fit; mutation dissolves the emptiest bins and some others.
After each epoch the best individual of an island migrates to the next island
of its block. Every island runs all its generations, also when no packing with
fewer bins can exist: then the sum of squared fills still gathers the free room
in few bins. The best packing of each block counts. Its bins that are not nearly
full are opened again and packed together with those of other blocks, level by
level, until one block is left or a level saves less than LEAST_SAVED of the
sequences still open, as where no two open sequences have room for each other's
documents.

Each task holds one block; blocks have BLOCK_ITEMS items on average whatever
the input's size. Results depend only on items and seeds, so a recomputed task
gives the same packing.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_store import parts
from .tokens import TOGETHER, encoder, forget
from .work import batch, materialize, tidied

CAPACITY = 2048
BLOCK_ITEMS, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 8192, 2, 2, 8, 24
#: A level that saves a smaller share of the open sequences is the last.
LEAST_SAVED = 0.001
#: A bin counts as well filled with at most this share of its room free.
SLACK = 0.004

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[int]:
    """The starts of a document's pieces: full ones, but for the first."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def _cutter(path: str, end_id: int, capacity: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages left in this worker
        enc, end = encoder(path), np.array([end_id], "<u4")
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for own, texts in parts(b, together):
                for key, x in zip(own, enc.encode(texts), strict=True):
                    data = memoryview(np.concatenate((x, end))).cast("B")
                    n = len(data) // 4
                    at = cuts(n, capacity)
                    for k, (start, stop) in enumerate(zip(at, [*at[1:], n], strict=True)):
                        for column, v in zip(out, (key, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])), strict=True):
                            column.append(v)
            yield batch(_PIECE, *out)

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, together: int = TOGETHER) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; a null text counts as empty and has the end id alone."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(_cutter(tokenizer, end_id, capacity, together)), _PIECE_DDL)


#: The groups of a packing and how full each is. A group's list is never changed, so packings share those that are alike.
Packing = tuple[list[list[int]], list[int]]


def best_fit(sizes: list[int], order: list[int], packing: Packing, capacity: int) -> Packing:
    """Place the items of order, one by one, where the least room stays free; packing's outer lists are changed in place.

    Bins are kept by their free room, and a bit set of the rooms that occur finds the least that suffices.
    """
    bins, fills = packing
    by_room: dict[int, list[int]] = {}
    for k, fill in enumerate(fills):
        if fill < capacity:
            by_room.setdefault(capacity - fill, []).append(k)
    rooms = sum(1 << room for room in by_room)
    for i in order:
        size = sizes[i]
        wide = rooms >> size
        if wide:
            room = size + (wide & -wide).bit_length() - 1
            held = by_room[room]
            k = held.pop()
            if not held:
                rooms ^= 1 << room
            bins[k] = [*bins[k], i]
            fills[k] += size
        else:
            room, k = capacity, len(bins)
            bins.append([i])
            fills.append(size)
        room -= size
        if room:
            if rooms >> room & 1:
                by_room[room].append(k)
            else:
                rooms |= 1 << room
                by_room[room] = [k]
    return packing


def crossover(into: Packing, source: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """into with about half of source's well-filled bins injected whole."""
    least = capacity * (1 - SLACK)
    chance = rng.random
    picked = [k for k, fill in enumerate(source[1]) if chance() < 0.5 and fill >= least]
    bins, fills = [source[0][k] for k in picked], [source[1][k] for k in picked]
    taken = {i for m in bins for i in m}
    displaced = []
    for m, fill in zip(*into, strict=True):
        if taken.isdisjoint(m):
            bins.append(m)
            fills.append(fill)
        else:
            displaced += [i for i in m if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(sizes, displaced, (bins, fills), capacity)


def mutate(packing: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Dissolve the bins that are not well filled and a few of the others, and place their items anew."""
    least = capacity * (1 - SLACK)
    chance = rng.random
    bins, fills, loose = [], [], []
    for m, fill in zip(*packing, strict=True):
        if fill < least or chance() < 0.03:
            loose += m
        else:
            bins.append(m)
            fills.append(fill)
    loose.sort(key=lambda i: sizes[i] * (0.9 + 0.2 * chance()), reverse=True)
    return best_fit(sizes, loose, (bins, fills), capacity)


def fitness(packing: Packing) -> tuple[int, int]:
    """Fewer bins first; then fuller ones, as their leftover room lies together."""
    return -len(packing[0]), sum(x * x for x in packing[1])


def evolve(sizes: list[int], seeds: list[Packing], capacity: int, population: int, generations: int, rng: random.Random) -> Packing:
    """The best packing after all generations, from the seeds and from best-fit packings in perturbed orders.

    Of a generation's two parents the fitter takes the other's well-filled bins in; the child replaces the least fit.
    """
    people = list(seeds)
    while len(people) < population:
        spread = 0.0 if not people else 0.15
        order = sorted(range(len(sizes)), key=lambda i: sizes[i] * (1 + rng.uniform(-spread, spread)), reverse=True)
        people.append(best_fit(sizes, order, ([], []), capacity))
    scored = sorted(((fitness(p), k, p) for k, p in enumerate(people)), reverse=True)
    for g in range(generations):
        a, b = sorted(rng.sample(range(len(scored)), 2))
        child = mutate(crossover(scored[a][2], scored[b][2], sizes, capacity, rng), sizes, capacity, rng)
        scored = sorted([*scored[:-1], (fitness(child), len(people) + g, child)], reverse=True)
    return scored[0][2]


def _labels(packing: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, m in enumerate(packing[0]):
        out[m] = k
    return out


def _packing(labels: np.ndarray, sizes: list[int]) -> Packing:
    order = np.argsort(labels, kind="stable")
    bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]
    return bins, [sum(sizes[i] for i in m) for m in bins]


_ISLAND_DDL = "block long, island int, items array<struct<item:long,length:int>>, elite binary, n_bins int, filled long"


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            elites, counts, filled = [], [], []
            for k in range(b.num_rows):
                block, island = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                sizes = b.column(2)[k].values.field(1).to_pylist()
                rng = random.Random(f"{block} {island} {epoch}")
                seeds = [_packing(np.frombuffer(e, np.int32), sizes) for e in (b.column(3)[k].as_py(), b.column(4)[k].as_py()) if e is not None]
                best = evolve(sizes, seeds, capacity, population, generations, rng)
                elites.append(_labels(best, len(sizes)).tobytes())
                counts.append(len(best[0]))
                filled.append(fitness(best)[1])
            new = [pa.array(elites, pa.binary()), pa.array(counts, pa.int32()), pa.array(filled, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + new, ["block", "island", "items", "elite", "n_bins", "filled"])

    return run


_PLACED = pa.schema([("item", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("filled", pa.int64())])
_PLACED_DDL = "item long, length long, sequence_id long, offset long, filled long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence, offset and fill of each item of a block's packing; a sequence has its smallest item's number."""
    for b in batches:
        for k in range(b.num_rows):
            of = b.column(0)[k].values
            items, sizes = of.field(0).to_numpy(zero_copy_only=False), of.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = np.frombuffer(b.column(1)[k].as_py(), np.int32)
            order = np.lexsort((items, labels))
            starts = np.flatnonzero(np.concatenate(([True], np.diff(labels[order]) != 0)))
            sums = np.cumsum(sizes[order])
            before = np.concatenate(([0], sums[:-1]))
            count = np.diff(np.concatenate((starts, [len(order)])))
            fill = np.add.reduceat(sizes[order], starts)
            yield batch(
                _PLACED, items[order], sizes[order], np.repeat(items[order][starts], count), before - np.repeat(before[starts], count), np.repeat(fill, count)
            )


def pack_items(
    items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS,
    epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS,
) -> DataFrame:
    """item, length, sequence_id, offset and filled of items (item unique, length from 1 to capacity)."""
    done, left, level = [], items.select("item", F.col("length").cast("int")), 0
    n, open_before = left.count(), None
    while True:
        blocks = max(1, -(-n // block_items))
        block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks))
        dealt = left.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("items"))
        state = dealt.select(
            "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", F.lit(None).cast("binary").alias("elite")
        ).withColumn("migrant", F.lit(None).cast("binary"))
        for epoch in range(epochs):
            if epoch:
                moved = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
                state = state.drop("n_bins", "filled").join(moved, ["block", "island"]).select("block", "island", "items", "elite", "migrant")
            run = _epoch(capacity, population, generations, epoch)
            state = materialize(state.repartition("block", "island").mapInArrow(tidied(run), _ISLAND_DDL), "islands")
        best = state.groupBy("block").agg(
            F.max(F.struct(-F.col("n_bins"), "filled", -F.col("island"))).alias("best")
        ).select("block", (-F.col("best")["col3"]).alias("island"))
        placed = materialize(state.join(best, ["block", "island"]).select("items", "elite").mapInArrow(tidied(_places), _PLACED_DDL), "packed")
        closed = F.col("filled") >= capacity * (1 - SLACK)
        first = F.col("offset") == 0
        n, n_open, total = placed.agg(F.count_if(~closed), F.count_if(first & ~closed), F.count_if(first)).first()
        saved = 1.0 if open_before is None else (open_before - total) / max(open_before, 1)
        if blocks == 1 or not n or saved < LEAST_SAVED:
            done.append(placed)
            break
        done.append(placed.where(closed))
        left, level, open_before = placed.where(~closed).select("item", F.col("length").cast("int")), level + 1, n_open
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, together: int = TOGETHER, **evolution: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document row.

    A null text counts as empty; a row that repeats a doc_id is a document of
    its own. Sequences are filled gaplessly from 0. An empty table gives none.
    Texts are encoded about together characters at a time: more is faster, less needs less memory.
    """
    cut = materialize(pieces(docs, tokenizer, end_id, capacity, together).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(cut.where(F.col("length") < capacity), capacity, **evolution)
    found = cut.join(placed.select("item", "sequence_id", "offset"), "item", "left")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"),
    )
