"""The nearest other vectors of every vector at once: a k-nearest-neighbour join in cells.

Equal vectors are one class, which the first few ids stand for, so very many
copies cost as much as one. Centres are fitted by k-means to a bounded sample of
classes (``SAMPLE_EACH`` for each centre, ``MOST_CELLS`` centres at most); every class
is then kept in the cell of its nearest centre. A class asks the cells of its
``probes`` nearest centres. Cells are dealt out in blocks of about ``BLOCK`` classes,
and one call compares one block of asking classes with one block of a cell, so
no cell, however full, is gathered at once; only the best k + 1 of each
comparison go on.

With ``exact``, blocks then meet every block of a cell that could still hold a
nearer vector for one of their classes: a cell whose centre is no farther than
the k-th distance found and the cell's radius together (the triangle inequality).
Where no cell can be left out, that is every pair of blocks; so vectors are not
copied for each cell that they ask, but parts of ``PART_BLOCKS`` blocks meet in a
cartesian product, which writes nothing, and only classes within the distance
already found leave a task. Without ``exact``, recall depends on ``probes``; a test
holds it at 0.9 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.operators.vectors import is_finite
from lexaloom.session import cut_statistics

CELL_ROWS, MOST_CELLS, SAMPLE_EACH, BLOCK = 512, 4096, 16, 1024
#: Blocks of a part in the exact pass, and rows whose distances to all centres are held at once.
PART_BLOCKS, STEP = 4, 1024
#: Decimal places of a squared distance; vectors at equal distances are in the order of their ids.
PLACES = 9


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of k-means from a sample of vectors, seeded by the sample's own order."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([_squares(sample[at : at + STEP], centres).argmin(axis=1) for at in range(0, len(sample), STEP)])
        count = np.bincount(home, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column; all have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, STEP) for at in range(0, b.num_rows, STEP))


def _home(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            far = _squares(_matrix(b.column(1)), shared.value)
            cell = far.argmin(axis=1)
            own = [pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(cell)), cell]))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "cell", "away"])

    return run


def _asked(shared: Broadcast, probes: int):
    """class, first, vector and cell for each of the nearest cells of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            near = np.argsort(_squares(_matrix(b.column(2)), shared.value), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(3)), pa.array(near.ravel().astype(np.int32))], ["class", "first", "vector", "cell"])

    return run


def _open(shared: Broadcast):
    """cell and other of the cells that a bound leaves open for one of a cell's classes; a pair at most once a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = shared.value
        for b in _steps(batches):
            bound = np.sqrt(b.column(2).to_numpy(zero_copy_only=False))
            row, other = np.nonzero(np.sqrt(_squares(_matrix(b.column(1)), centres)) - radius[None, :] <= bound[:, None] + 1e-6)
            cell = b.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            cell, other = np.divmod(np.unique(cell * len(centres) + other), len(centres))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(other.astype(np.int32))], ["cell", "other"])

    return run


def _nearest(q: np.ndarray, h: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of h and distances of the k + 1 nearest of each row of q, those beyond a row's bound left out."""
    far = _squares(q, h)
    if bound is None:
        bound = np.full(len(q), np.inf)
    if len(h) > k + 1:
        bound = np.minimum(bound, np.partition(far, k, axis=1)[:, k]) if np.isinf(bound).any() else bound
    row, at = np.nonzero(far <= (bound + 10.0**-PLACES)[:, None] * (1 + 1e-9))
    found = np.round(far[row, at], PLACES)
    order = np.lexsort((ids[at], found, row))
    row, at, found = row[order], at[order], found[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) <= k
    return row[keep], at[keep], found[keep]


def _named(asks, held, row: np.ndarray, at: np.ndarray, found: np.ndarray) -> list[pa.Array]:
    at = pa.array(at)
    return [asks.take(pa.array(row)), held[0].take(at), held[1].take(at), pa.array(found)]


FOUND, FOUND_DDL = ["class", "other", "first", "distance"], "class long, other long, first long, distance double"


def _compare(k: int):
    """class, other, first and distance of the k + 1 nearest classes of a block for each class that asks, itself included."""

    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows or not held.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], FOUND)
        asks, held = asks.combine_chunks(), held.combine_chunks()
        column = lambda t, name: t.column(name).combine_chunks()
        found = _nearest(_matrix(column(asks, "vector")), _matrix(column(held, "vector")), column(held, "first").to_numpy(zero_copy_only=False), k)
        return pa.table(_named(column(asks, "class"), [column(held, "class"), column(held, "first")], *found), FOUND)

    return run


def _compare_within(k: int):
    """The same of whole blocks, asks (class, first, vector, bound) and held (class, first, vector), within each class's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asks, held in zip(b.column(0), b.column(1), strict=True):
                q, h = asks.values, held.values
                found = _nearest(_matrix(q.field(2)), _matrix(h.field(2)), h.field(1).to_numpy(zero_copy_only=False), k, q.field(3).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(_named(q.field(0), [h.field(0), h.field(1)], *found), FOUND)

    return run


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows with name, the number of a block of about BLOCK of the cell's rows."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return rows.join(F.broadcast(sizes), "cell").withColumn(name, F.pmod(F.xxhash64("class"), F.col("blocks"))).drop("blocks")


def _compared(asking: DataFrame, homes: DataFrame, k: int) -> DataFrame:
    """What _compare finds for each block of asking (class, first, vector, cell) and each block of its cell."""
    asks, held = cut_statistics(_dealt(asking, "ask")), cut_statistics(_dealt(homes.select("class", "first", "vector", "cell"), "hold"))
    pair = F.struct("cell", "ask", "hold")
    left = asks.join(F.broadcast(held.select("cell", "hold").distinct()), "cell").select(pair.alias("left"), "class", "vector")
    right = held.join(F.broadcast(asks.select("cell", "ask").distinct()), "cell").select(pair.alias("right"), "class", "first", "vector")
    return left.groupBy("left").cogroup(right.groupBy("right")).applyInArrow(_compare(k), FOUND_DDL)


def _compared_within(homes: DataFrame, opened: DataFrame, k: int) -> DataFrame:
    """What _compare_within finds for each block of homes (class, first, vector, cell, bound) and each block of the cells that are open to it."""
    dealt = _dealt(homes, "block").groupBy("cell", "block").agg(F.collect_list(F.struct("class", "first", "vector", "bound")).alias("asks"))
    blocks = cut_statistics(dealt.join(opened, "cell").select("cell", "open", "asks"))
    parts = -(-blocks.count() // PART_BLOCKS)
    asks = blocks.select("open", "asks").repartition(parts)
    held = blocks.select(F.col("cell").alias("at"), F.transform("asks", lambda x: x.dropFields("bound")).alias("held")).repartition(parts)
    pairs = asks.join(held.hint("shuffle_replicate_nl"), F.array_contains("open", F.col("at"))).select("asks", "held")
    return pairs.mapInArrow(_compare_within(k), FOUND_DDL)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("class").orderBy("distance", "first"))
    return found.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")


def nearest_join(vectors: DataFrame, k: int, probes: int = 8, exact: bool = False, cells: int | None = None) -> DataFrame:
    """id, other, distance (squared) and rank of the k nearest other rows of each row of vectors (id, vector).

    Ids are integers and distinct. Rows whose vector is null, empty or not
    finite are left out; vectors of different lengths are an error. Ties go to
    the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(is_finite(F.col("vector")) & F.col("id").isNotNull())
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    classes = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = cut_statistics(classes.select(F.monotonically_increasing_id().alias("class"), "vector", "ids"))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "id long, other long, distance double, rank int")
    cells = min(n, cells or -(-n // CELL_ROWS), MOST_CELLS)
    sample = classes.orderBy(F.xxhash64("class")).limit(SAMPLE_EACH * cells).select("vector").toArrow().column(0).combine_chunks()
    centres = fit_centres(_matrix(sample), cells)
    shared = spark.sparkContext.broadcast(centres)
    homes = classes.select("class", "vector", F.get("ids", F.lit(0)).alias("first")).mapInArrow(_home(shared), "class long, vector array<double>, first long, cell int, away double")
    homes = cut_statistics(homes)
    own = homes.select("class", "first", "vector")
    asked = own.mapInArrow(_asked(shared, probes), "class long, first long, vector array<double>, cell int")
    found = cut_statistics(_best(_compared(asked, homes, k), k))
    if exact and cells > probes:
        radius = np.zeros(cells)
        for r in homes.groupBy("cell").agg(F.max("away").alias("away")).collect():  # a row a cell
            radius[r["cell"]] = r["away"]
        bound = found.groupBy("class").agg(F.when(F.count(F.lit(1)) > k, F.max("distance")).otherwise(float("inf")).alias("bound"))
        bounded = cut_statistics(homes.join(bound, "class").select("class", "first", "vector", "cell", "bound"))
        opened = bounded.select("cell", "vector", "bound").mapInArrow(_open(spark.sparkContext.broadcast((centres, radius))), "cell int, other int")
        opened = opened.groupBy("cell").agg(F.collect_set("other").alias("open"))
        found = cut_statistics(_best(_compared_within(bounded, opened, k), k))
    near = found.join(classes.select(F.col("class").alias("other"), "ids"), "other").select("class", "distance", F.explode("ids").alias("other"))
    lists = near.groupBy("class").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k + 1).alias("near"))
    members = rows.join(cut_statistics(classes.join(lists, "class").select("vector", "near")), "vector")
    others = members.select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    return others.select("id", F.posexplode("near").alias("at", "x")).select("id", F.col("x.other").alias("other"), F.col("x.distance").alias("distance"), (F.col("at") + 1).alias("rank"))
