"""Benchmark decontamination with a generalised suffix automaton of test items.

The items' words build one automaton whose states are the sets of word
sequences with the same occurrences in all items. A document's words stream
through it: the automaton holds at each word the longest item passage that ends
there. A window is ``window`` consecutive item words (a shorter item is one
window); a word of a document inside an occurrence of a window is hit.

Items are dealt by hash into blocks of about ``block_words`` words (a stated query
set against all rows, in blocks). A task builds a block's automaton and writes it
to the shared folder. A block's automaton at a time is read from there and
broadcast, its size bound by that parameter whatever the benchmark's size, and one
narrow pass over the documents serves it. With several blocks the passes' hits are
united by document. No document text is shuffled.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import fresh, materialize, raw, slices, tidied

WINDOW = 10
BLOCK_WORDS = 200_000
#: Passes in one stage; each has an automaton in the memory of its own worker.
CHAIN = 4
#: Bytes of a written automaton in a row.
PIECE_BYTES = 1 << 22

#: Upper case to lower case; ASCII that is neither letter nor digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased maximal runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over items' words, with the windows that each state stands for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.items = [name for name, ws in items if ws]
        full: list[tuple[int, int, int]] = []  # a long item's states, each with the item: windows that end there
        short: list[tuple[int, int, int]] = []
        for number, (_, ws) in enumerate((n, w) for n, w in items if w):
            last, path = 0, []
            for w in ws:
                last = self._extend(last, self.codes.setdefault(w, len(self.codes)))
                path.append(last)
            if len(ws) < window:
                short.append((path[-1], len(ws), number))
            else:
                full += [(s, window, number) for s in path[window - 1 :]]
        self._mark(full, short)

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the words of q that are no longer than those of p and c."""
        made = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        made, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return made

    def _mark(self, full: list, short: list) -> None:
        """found[s]: (words, item) of each window that is a suffix of state s's words."""
        own: list[dict[int, set[int]]] = [{} for _ in self.length]
        for state, n, item in full + short:
            while self.link[state] >= 0 and self.length[self.link[state]] >= n:
                state = self.link[state]
            own[state].setdefault(n, set()).add(item)
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for s in sorted(range(1, len(own)), key=self.length.__getitem__):
            mine = tuple((n, i) for n in sorted(own[s]) for i in sorted(own[s][n]))
            above = self.found[self.link[s]]
            self.found[s] = mine + above if mine else above
        self.least = min([self.window] + [n for _, n, _ in short])

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Hit spans of ws, as rows (first, end) that may overlap, and the items with occurring windows.

        Only runs of known words that are at least as long as the shortest
        window pass through the automaton: an unknown word always resets it.
        """
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        get = self.codes.get
        codes = [get(w, -1) for w in ws]
        known = np.array(codes, np.int32) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        following, link, length, found, window = self.next, self.link, self.length, self.found, self.window
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first < self.least:
                continue
            state = n = 0
            for i in range(first, end):
                c = codes[i]
                to = following[state].get(c)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = following[state].get(c)
                if to is None:
                    n = 0
                    continue
                state = to
                n += 1
                if found[state]:
                    most = 0
                    for size, item in found[state]:
                        if size <= n:
                            items.add(item)
                            most = max(most, size)
                    if n >= window:
                        most = n
                    if most:
                        spans.append((i + 1 - most, i + 1))
        return np.array(spans, np.int64).reshape(-1, 2), items


def united(spans: np.ndarray) -> np.ndarray:
    """The disjoint spans, in order, that cover the same words."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    starts = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[starts, 0], reach[np.concatenate((starts[1:] - 1, [len(spans) - 1]))]), 1)


#: Columns that a pass adds: word count, disjoint hit spans (first and end of each, flat), ids of items with occurring windows.
_FOUND = T.StructType(
    [T.StructField("_n_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))]
)


def stretches(ws: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """ws in stretches of most words, each of which begins window - 1 words before the end of the one before: every window lies in one of them."""
    if len(ws) <= most:
        return [ws] if ws else []
    step = most - window + 1
    return [ws[k : k + most] for k in range(0, len(ws) - window + 1, step)]


def _cut(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, part) for i, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True) for part in stretches(words(t), window, most)]
            columns = [[i for i, _ in rows], [b" ".join(x).decode() for _, x in rows], [len(x) for _, x in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["item", "text", "n"])

    return run


def _build(window: int):
    """block, at and piece: the automaton of each block of rows (block, item, text) that come sorted by block."""

    def written(block: int, items: list[tuple[str, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        data = pickle.dumps(Automaton(items, window), 5)
        for at in range(0, len(data), PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([data[at : at + PIECE_BYTES]])], ["block", "at", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items = None, []
        for b in batches:
            for block, item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                if block != now:
                    if items:
                        yield from written(now, items)
                    now, items = block, []
                items.append((item or "", words(text)))
        if items:
            yield from written(now, items)

    return run


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """The written automata (block, at, piece) of a benchmark's items, built in tasks, and the number of blocks.

    An item's rows may lie in several blocks: hits are united by item id. Rows
    that repeat an item's text count once, and a long item is cut into stretches
    that overlap, so no block is much larger than block_words.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    cut = materialize(items.mapInArrow(_cut(window, max(2 * window, block_words // 16)), "item string, text string, n long"), "items")
    total = cut.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    dealt = cut.select(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).alias("block"), "item", "text")
    built = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(_build(window)), "block long, at long, piece binary")
    return materialize(built, "automata"), blocks


class _Shared:
    """A block's written automaton, broadcast; a worker loads it once."""

    loaded: tuple[str, Automaton] | None = None

    def __init__(self, pieces: DataFrame, block: int, window: int):
        rows = pieces.where(F.col("block") == block).orderBy("at").collect()  # one block, bound by block_words
        data = b"".join(r["piece"] for r in rows) or pickle.dumps(Automaton([], window), 5)
        self.name, self.data = uuid.uuid4().hex, pieces.sparkSession.sparkContext.broadcast(data)

    def automaton(self) -> Automaton:
        if _Shared.loaded is None or _Shared.loaded[0] != self.name:
            _Shared.loaded = (self.name, pickle.loads(self.data.value))
        return _Shared.loaded[1]


def annotate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = True,
    then: tuple[Callable[[Iterator], Iterator], T.StructType] | None = None,
) -> DataFrame:
    """docs (without text if so asked) with the columns of _FOUND (underscores before a name that docs has).

    A pass is a narrow map; the next block's pass takes the columns that the
    one before has found and adds to them. then is a map over the result's
    batches, with its schema, that the last pass's worker does as well: a map
    of its own would have another Python worker beside it in every task.
    """
    pieces, blocks = automata(benchmark, window, block_words)
    names = docs.columns
    added = T.StructType([T.StructField(fresh(names, f.name), f.dataType) for f in _FOUND])
    out, alive = docs, []
    for k in range(blocks):
        if k and k % CHAIN == 0:
            out = materialize(out, "annotated")
            for shared in alive:
                shared.data.unpersist()
            alive = []
        last = k == blocks - 1
        kept = [n for n in names if keep_text or n != "text" or not last]
        schema = T.StructType([docs.schema[n] for n in kept] + added.fields)
        alive.append(_Shared(pieces, k, window))
        run = _scanner(alive[-1], names.index("text"), [names.index(n) for n in kept], k > 0, added.names)
        if then and last:
            run, schema = _after(run, then[0]), then[1]
        out = out.mapInArrow(tidied(run), schema)
    return out


def _after(first: Callable[[Iterator], Iterator], second: Callable[[Iterator], Iterator]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return second(first(batches))

    return run


def _scanner(shared, text: int, kept: list[int], more: bool, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.automaton()
        for b in slices(batches):
            counts, spans, items = [], [], []
            for k, data in enumerate(raw(b.column(text))):
                ws = words(data)
                at, found = automaton.scan(ws)
                found = {automaton.items[i] for i in found}
                if more:
                    at = np.concatenate((np.array(b.column(b.num_columns - 2)[k].as_py(), np.int64).reshape(-1, 2), at))
                    found.update(b.column(b.num_columns - 1)[k].as_py())
                counts.append(len(ws))
                spans.append(united(at).ravel())
                items.append(sorted(found))
            new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + new, [b.schema.names[i] for i in kept] + added)

    return run


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids) and contaminated, for each document row.

    Null texts have no words; without items, or in an empty table, nothing is hit.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = annotate(base, benchmark, window, block_words, keep_text=False)
    hit = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size("_spans") - 2, F.lit(0)), F.lit(2)),
        F.lit(0).cast("long"),
        lambda s, i: s + F.coalesce(F.get("_spans", i + 1) - F.get("_spans", i), F.lit(0).cast("long")),
    )
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_spans(data: bytes, spans: np.ndarray) -> bytes:
    """data without the words of the spans and what stands between a stretch's first and last word."""
    folded = np.frombuffer(data.translate(_FOLD), np.uint8)
    is_word = np.concatenate(([False], folded != 32, [False]))
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for first, end in spans.tolist():
        out.append(data[at : starts[first]])
        at = int(ends[end - 1])
    return b"".join([*out, data[at:]])


def _remover(text: int, n: int, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, texts = [], []
            for k, (data, flat, total) in enumerate(zip(raw(b.column(text)), b.column(n + 1).to_pylist(), b.column(n).to_pylist(), strict=True)):
                spans = np.array(flat, np.int64).reshape(-1, 2)
                if len(spans) and (spans[:, 1] - spans[:, 0]).sum() > max_coverage * total:
                    continue
                kept.append(k)
                texts.append(data if data is None or not len(spans) else remove_spans(data, spans))
            b = b.take(pa.array(kept, pa.int64()))
            columns = [b.column(i) if i != text else pa.array([None if t is None else t.decode() for t in texts], pa.string()) for i in range(n)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:n])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs with every hit span removed from text; columns as given.

    A document of whose words more than max_coverage are hit goes as a whole.
    Documents without hits, without words or with a null text stay as they are.
    """
    names = docs.columns
    plain = docs.withColumn("text", F.col("text").cast("string"))
    remove = _remover(names.index("text"), len(names), max_coverage)
    return annotate(plain, benchmark, window, block_words, then=(remove, plain.schema))
