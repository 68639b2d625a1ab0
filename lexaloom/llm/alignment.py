"""Alignment of two tokenizers' tokens by diagonal run skipping.

A text is encoded by a byte-level BPE (A, with a space before it) and by a
sentencepiece model (B, which adds that space). Both give tokens that stand for
bytes, so each is an array of end offsets. Where one token meets one token, the
two arrays are equal at a constant shift of their indexes. Exponential probing
compares stretches of both at the shift that holds, each twice as long as the
last, and halves where they differ; so it jumps over one-to-one tokens. At a
difference the two ends are advanced in turn until they meet; that closes a
group of several tokens, and its numbers of tokens give the next shift.

Texts are cut for encoding at single spaces between visible characters, where
no token of either kind goes across; a unit's ids are kept by the worker that
has met it. Groups, links and digests are made of whole documents.

A group has one link, its last A and last B token. Of two tokens that end
together one ends with all bytes of the other, so the two vocabularies allow a
limited number of id pairs (``most_pairs``), whatever the data's size; the table
of their counts over the whole corpus is broadcast with that bound checked.
Links lie in the shared folder between the pass that counts and the one that
looks counts up.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .token_store import parts
from .tokens import _ODD, Encoder, _bytes_of_units
from .work import batch, materialize, tidied, tidy

#: Units whose B ids are kept in each of two generations by a Python worker, and the longest that are kept.
CACHE_UNITS, LONGEST_UNIT = 100_000, 64
#: First and longest stretch of a probe.
FIRST_PROBE, LONGEST_PROBE = 8, 1 << 16
#: Characters that are encoded together, and tokens of A that are aligned together, if of more than one document.
TOGETHER, ALIGNED = 1 << 21, 1 << 17
#: Documents whose links are looked up together.
TOGETHER_DOCS = 1024

#: A single space between a character that is none and a visible one, where texts are cut.
_CUT = re.compile("(?<=[^ ]) (?=[!-~¡-ᙿ])")
_VISIBLE = re.compile("[!-~¡-ᙿ]")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class Pair:
    """Both tokenizers: ids, byte lengths and decimal names of tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = token_bytes_a(self.a)
        self.bytes_b = token_bytes_b(self.b)
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n, m = len(self.bytes_a), len(self.bytes_b)
        #: An id of A and one of B are one number, B's in the lowest bits; it is four bytes wide if that is enough.
        self.bits = (m - 1).bit_length()
        self.narrow = (n - 1).bit_length() + self.bits <= 31
        #: Each id with the mark behind it: A inside of a group and at its end, B inside and at its end.
        self.names = np.array(
            [b"%d," % i for i in range(n)] + [b"%d|" % i for i in range(n)] + [b"%d," % i for i in range(m)] + [b"%d;" % i for i in range(m)], object
        )
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def _ids_a(self, units: list[str]) -> list[bytes]:
        """A's ids of each unit with a space before it."""
        plain = [u for u in units if _VISIBLE.match(u)]
        if len(plain) == len(units):
            return self.a.listed(plain)
        found = iter(self.a.listed(plain))
        return [next(found) if _VISIBLE.match(u) else self.a._whole(" " + u) for u in units]

    def _ids_b(self, units: list[str]) -> list[bytes | None]:
        """B's ids of each unit, which adds the space; None where their bytes are not the unit's."""
        if len(self.young) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = [*map(young.get, units)]
        holes = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in holes:
            u = units[k]
            if u in old:
                found[k] = old[u]
                young[u] = old[u]
            else:
                new.append(k)
        names = self.bytes_b.__getitem__
        for k, ids in zip(new, self.b.encode([units[k] for k in new], num_threads=1), strict=True):
            u = units[k]
            if b"".join(map(names, ids)) == b" " + u.encode():
                found[k] = array("i", ids).tobytes()
                if len(u) <= LONGEST_UNIT:
                    young[u] = found[k]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of A and of B, and how many of each every text has.

        A text that is empty, or for which the bytes of either's ids are not those of space and text, has none.
        """
        odd = [t[:1] == " " or _ODD.search(t) is not None for t in texts]
        plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.large_string()), " ")
        other = [_CUT.split(t) for t, o in zip(texts, odd, strict=True) if o]
        order = np.argsort(odd, kind="stable")  # plain texts first
        counts = np.concatenate((pc.list_value_length(plain).to_numpy(zero_copy_only=False), [len(x) for x in other])).astype(np.int64)
        cut = pa.concat_arrays([plain.flatten(), pa.array([u for x in other for u in x], pa.large_string())]).dictionary_encode()
        codes, units = cut.indices.to_numpy().astype(np.int64), cut.dictionary.to_pylist()
        ids_a, ids_b = self._ids_a(units), self._ids_b(units)
        size_a = np.array([len(x) // 4 for x in ids_a], np.int64)
        size_b = np.array([0 if x is None else len(x) // 4 for x in ids_b], np.int64)
        of_text = np.repeat(order, counts)
        n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
        flat_a = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64)
        unit_bytes = np.diff(np.concatenate(([0], np.cumsum(self.len_a[flat_a])))[np.concatenate(([0], np.cumsum(size_a)))])
        lost = np.bincount(of_text, size_b[codes] == 0, len(texts)) + (np.bincount(of_text, unit_bytes[codes], len(texts)) != n_bytes + 1)
        good = (lost == 0) & (n_bytes > 0)
        if any(odd):  # back in the order of the texts
            at = np.argsort(of_text, kind="stable")
            of_text, codes = of_text[at], codes[at]
        kept = good[of_text]
        own, codes = of_text[kept], codes[kept]
        flat_b = np.frombuffer(b"".join([x or b"" for x in ids_b]), "<i4").astype(np.int64)
        each = [np.bincount(own, s[codes], len(texts)).astype(np.int64) for s in (size_a, size_b)]
        return _gathered(flat_a, size_a, codes), _gathered(flat_b, size_b, codes), *each

    def align_texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """The numbers of A's and B's ids and of groups, the digest of the groups and the links of each text."""
        a, b, n_a, n_b = self.encode(texts)
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        first = 0
        while first < len(texts):
            before_a, before_b = end_a[first] - n_a[first], end_b[first] - n_b[first]
            last = max(first + 1, int(np.searchsorted(end_a, before_a + ALIGNED, "right")))
            own_a, own_b = a[before_a : end_a[last - 1]], b[before_b : end_b[last - 1]]
            # each text's end is an end of both, so texts can be aligned one behind the other
            last_a, last_b = spread(*align(self.len_a[own_a].cumsum().tolist(), self.len_b[own_b].cumsum().tolist()))
            names = self._names(own_a, own_b, last_a, last_b)
            links = own_a[last_a] << self.bits | own_b[last_b]
            group = np.searchsorted(last_a, end_a[first:last] - before_a).tolist()
            named = (end_a[first:last] - before_a + end_b[first:last] - before_b).tolist()
            g = m = 0
            for k, g_end, m_end in zip(range(first, last), group, named, strict=True):
                digest = hashlib.sha256(b"".join(names[m:m_end].tolist())[:-1]).hexdigest() if m_end > m else ""
                yield int(n_a[k]), int(n_b[k]), g_end - g, digest, links[g:g_end]
                g, m = g_end, m_end
            first = last

    def _names(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
        """The groups as pieces of ``a1,a2|b1;a3|b2,b3;``, one for each id."""
        n, m = len(self.bytes_a), len(self.bytes_b)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        names = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, size_b)
        names[at_a], names[at_b] = a, b + 2 * n
        names[at_a[last_a]] += n
        names[at_b[last_b]] += m
        return self.names[names]


def _gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The values of each code's stretch of flat, one stretch behind the other."""
    if not len(codes):
        return flat[:0]
    n = sizes[codes]
    ends = np.cumsum(n)
    return flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + n, n) + np.arange(ends[-1])]


def token_bytes_a(enc: Encoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; those of other tokens are their text's."""
    alphabet = _bytes_of_units()
    out = [b""] * enc.size
    for token, i in enc.tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def token_bytes_b(model) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE.fullmatch(piece) if model.is_byte(i) else None
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return out


def most_pairs(bytes_a: list[bytes], bytes_b: list[bytes]) -> int:
    """How many id pairs can be linked at most: of each linked pair one token ends with all bytes of the other."""
    by_b: dict[bytes, int] = {}
    for x in bytes_b:
        by_b[x] = by_b.get(x, 0) + 1
    by_a: dict[bytes, int] = {}
    for x in bytes_a:
        by_a[x] = by_a.get(x, 0) + 1
    inside_a = sum(by_b.get(x[k:], 0) for x in bytes_a for k in range(len(x)))
    return inside_a + sum(by_a.get(x[k:], 0) for x in bytes_b for k in range(1, len(x)))


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Where groups end, as runs: a run of k groups ends at the tokens i, i + 1, ... of A and j, j + 1, ... of B.

    Both lists ascend strictly and end with the same number. All groups of a run
    but the first are one token each, at the run's shift j - i. Returns i, j and k of the runs.
    """
    at_a, at_b, sizes = [], [], []
    i = j = 0
    n = len(ends_a)
    while i < n:
        x, y = ends_a[i], ends_b[j]
        while x != y:  # an irregular group
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        at_a.append(i)
        at_b.append(j)
        first = i
        i += 1
        j += 1
        width, growing = FIRST_PROBE, True
        while width and i < n:  # probe along the diagonal
            run = ends_a[i : i + width]
            if run == ends_b[j : j + width]:
                i += len(run)
                j += len(run)
            else:
                growing = False
            width = min(2 * width, LONGEST_PROBE) if growing else width // 2
        sizes.append(i - first)
    return at_a, at_b, sizes


def spread(at_a: list[int], at_b: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the last tokens of all groups, from runs."""
    n = np.array(sizes, np.int64)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.array(at_a, np.int64), n) + inside, np.repeat(np.array(at_b, np.int64), n) + inside


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """Both tokenizers of this Python worker."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


_HEAD = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
_HEAD_DDL = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"


def _aligner(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for arrived in batches:
            for keys, texts in parts(arrived, TOGETHER):
                rows = [(key, *found) for key, found in zip(keys, both.align_texts(texts), strict=True)]
                *columns, links = zip(*rows, strict=True)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in links]))).astype(np.int32)
                values = np.concatenate(links).astype(np.int32 if both.narrow else np.int64)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield batch(pa.schema([*_HEAD, ("links", listed.type)]), *columns, listed)

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the number of each row's."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones; what the worker has kept for encoding goes first."""
    _PAIRS.clear()
    tidy()
    for b in batches:
        for start in range(0, b.num_rows, TOGETHER_DOCS):
            yield b.slice(start, TOGETHER_DOCS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        values, counts = np.unique(_flat(b.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["link", "n"])


def aligned(docs: DataFrame, path_a: str, path_b: str, narrow: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links (A's id in the upper bits, B's in the lower) of each document; a map.

    narrow: what Pair says of the two vocabularies.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_aligner(path_a, path_b)), f"{_HEAD_DDL}, links array<{'int' if narrow else 'long'}>")


def link_counts(found: DataFrame, bits: int) -> DataFrame:
    """link, n (its number of occurrences in the corpus) and best (no other link of its B id has more), from aligned()."""
    counted = found.select("links").mapInArrow(_counted, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    b = F.col("link").bitwiseAND(F.lit((1 << bits) - 1))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


_SUMMED = pa.schema([*_HEAD, ("n_best", pa.int64()), ("count_sum", pa.int64())])
_SUMMED_DDL = f"{_HEAD_DDL}, n_best long, count_sum long"


def _looker(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for b in _slices(batches):
            values, sizes = _flat(b.column(5))
            at = np.searchsorted(keys, values)
            ends = np.cumsum(sizes)
            sums = [np.concatenate(([0], np.cumsum(x[at]))).astype(np.int64) for x in (best, counts)]
            yield batch(_SUMMED, *(b.column(k) for k in range(5)), *(pa.array(s[ends] - s[ends - sizes]) for s in sums))

    return run


def cross_align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    path_a is a byte-level BPE of the tokenizers library, path_b a sentencepiece
    model that adds a space. n_links equals n_groups; n_best counts the links
    whose number of occurrences over all rows is the largest of their B id, ties
    included; count_sum adds those numbers up. A text that is null, empty or
    changed by either tokenizer has zeros and an empty digest. Repeated rows
    each count; a null doc_id stays null. An empty table gives no row, and other
    columns are not read.
    """
    spark = docs.sparkSession
    here = Pair(path_a, path_b)
    found = materialize(aligned(docs, path_a, path_b, here.narrow), "aligned")
    table = materialize(link_counts(found, here.bits), "link-counts")
    most = most_pairs(here.bytes_a, here.bytes_b)
    if table.count() > most:
        raise ValueError(f"more than {most} id pairs are linked, which the two vocabularies do not allow")
    got = table.orderBy("link").toArrow()
    columns = tuple(got.column(c).to_numpy().astype(t) for c, t in (("link", np.int32 if here.narrow else np.int64), ("n", np.int64), ("best", bool)))
    shared = spark.sparkContext.broadcast(columns)
    done = found.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(_looker(shared), _SUMMED_DDL)
    return done.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
