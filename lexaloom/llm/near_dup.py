"""Near-duplicate detection with b-bit MinHash.

A document's set is its distinct 5-word shingles, hashed to 64 bits. The K
minima under K permutations are mixed and 8 bits of each are kept, packed into
one signature of K bytes. Bands of ROWS consecutive bytes give candidates. The
share of equal bytes of two signatures, counted on their xor, estimates their
similarity once the chance of equal bytes is taken out; candidates below the
threshold by more than MARGIN (five standard deviations) go. The others are
confirmed on whole sets, made again from the texts. A pair at similarity 0.75
shares no band with probability 8e-5, one at 0.8 with 4e-7.

Equal sets are one class, so copies cost one row. A band that very many classes
share is not expanded into pairs:
1. each class is compared with one class only, the smallest that any of its
   bands leads to and whose estimate passes; confirmed links give components;
2. the classes that are still apart are compared with their bands' smallest;
3. the classes of bands that still hold several components are joined by their
   rarest shingles: two sets can only be similar enough if they share one of
   the n - ceil(0.75 n) + 1 rarest shingles of each (prefix filter), with enough
   others behind it in both (positional filter). A class goes to the tasks of
   its own rarest shingles, so what is sent grows with the texts' lengths and
   not with how many classes share a band; a band or passage that many texts
   share is not among the rarest.
Links inside a component need no test, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import TASK_TEXTS, batch, few, materialize, raw, sieve, slices, tidied

SHINGLE, THRESHOLD = 5, 0.75
BANDS, ROWS = 48, 6
K = BANDS * ROWS
MARGIN = 5 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5
SALT_ROWS = 64
#: Counters of shingle frequencies, and rare shingles in a task's part.
COUNTERS, PART_SHINGLES = 1 << 20, 1 << 19
#: Distinct words whose hashes a Python worker keeps.
CACHE_WORDS = 100_000

_U64 = np.uint64
_rng = np.random.default_rng(2)
_A = (_rng.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)[:, None]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, one hash of them all; without words, none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, _U64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U64)
    h = np.fromiter(map(_WORDS.__getitem__, words), _U64, len(words))
    n = len(words) - SHINGLE + 1
    s = h[:n].copy()
    for k in range(1, SHINGLE):
        s *= _U64(0x9E3779B97F4A7C15)
        s ^= s >> _U64(29)
        s += h[k : n + k]
    s ^= s >> _U64(32)
    s *= _U64(0xD6E8FEB86659FD93)
    s ^= s >> _U64(32)
    return np.unique(s)


def signature(found: np.ndarray) -> bytes:
    """8 bits of each of the K mixed minima of a set."""
    x = (found >> _U64(32)).astype(np.uint32)
    least = np.full((K, 1), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        values = _A * x[None, at : at + 512]
        values += _B
        np.minimum(least, values.min(axis=1, keepdims=True), out=least)
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(24)).astype(np.uint8).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis), with the chance of equal low bits taken out."""
    differ = (a ^ b).view(np.uint64)
    for shift in (4, 2, 1):  # a byte's low bit is set if any of its bits is
        differ = differ | (differ >> _U64(shift))
    unequal = np.bitwise_count(differ & _U64(0x0101010101010101)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-8
    return ((K - unequal) / K - chance) / (1 - chance)


def close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * 75


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sig", pa.binary())])
_SIGNED_DDL = "doc_id long, text_hash long, n_shingles long, set_hash binary, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingles(t) for t in raw(b.column(1))]
        yield batch(
            _SIGNED, b.column(0), b.column(2), [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            [signature(s) if len(s) else None for s in sets],
        )


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and b of the rows (a, b, n_a, n_b, sig_a, sig_b) that may be similar enough."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, K) for i in (4, 5))
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        good = pa.array(close(n, m) & (estimate(x, y) >= THRESHOLD - MARGIN))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])


def estimated(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b), of which there are at most so many, of classes whose sizes and signatures allow the threshold."""
    own = classes.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    other = classes.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    wide = pairs.join(own, "a").join(other, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    return few(wide, most).mapInArrow(_estimates, "a long, b long")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed pairs of rows (b, salt, a, text) in which each group (b, salt) starts with b itself (a null)."""
    now, base = None, None
    for batch_ in slices(batches):
        found: tuple[list[int], list[int]] = ([], [])
        keys = zip(batch_.column(0).to_pylist(), batch_.column(1).to_pylist(), batch_.column(2).to_pylist(), raw(batch_.column(3)), strict=True)
        for b, salt, a, text in keys:
            if a is None:
                now, base = (b, salt), shingles(text)
                continue
            if now != (b, salt):
                raise ValueError("a group has lost its first row")
            own = shingles(text)
            shared = len(np.intersect1d(own, base, assume_unique=True))
            if 100 * shared >= 75 * (len(own) + len(base) - shared):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b), of which there are at most so many, whose whole sets are similar enough; texts has class_id and text.

    Many pairs may share one b: they are dealt into groups of about SALT_ROWS, each with one copy of b's text.
    """
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / SALT_ROWS)).alias("salt"))
    salted = materialize(salted, "salted", most)
    members = salted.join(texts, salted["a"] == texts["class_id"]).select("b", "salt", F.col("a").alias("a"), "text")
    firsts = salted.select("b", "salt").distinct().join(texts, F.col("b") == texts["class_id"])
    firsts = firsts.select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    rows = few(members.unionByName(firsts).repartition("b", "salt"), 2 * most, TASK_TEXTS).sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return rows.mapInArrow(tidied(_confirm), "a long, b long")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often shingles of each counter occur in the texts of rows (class_id, component, text)."""
    total = np.zeros(COUNTERS, np.int64)
    for b in slices(batches):
        own = [(shingles(text) % _U64(COUNTERS)).astype(np.int64) for text in raw(b.column(2))]
        at, n = np.unique(np.concatenate(own), return_counts=True)
        total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["counter", "n"])


_RARE = pa.schema(
    [("part", pa.int32()), ("class_id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("found", pa.binary()), ("places", pa.binary())]
)


def _rarest(frequency, parts: int):
    """For each class and part the class's rarest shingles in it and their places in the order by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in _RARE]
            for key, component, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                own = shingles(text)
                n = len(own)
                order = np.argsort(frequency.value[(own % _U64(COUNTERS)).astype(np.int64)], kind="stable")  # own is sorted: ties by hash
                first = own[order[: n - (3 * n + 3) // 4 + 1]]
                part = ((first >> _U64(32)) % _U64(parts)).astype(np.int32)
                for k in np.unique(part).tolist():
                    at = np.flatnonzero(part == k)
                    for column, v in zip(out, (k, key, component, n, first[at].tobytes(), at.astype(np.int32).tobytes()), strict=True):
                        column.append(v)
            yield batch(_RARE, *out)

    return run


def _meetings(rows: list[tuple]) -> pa.RecordBatch:
    """a > b of classes of different components that share a rare shingle of a part and can be similar enough."""
    counts = np.array([len(r[3]) // 8 for r in rows])
    token = np.frombuffer(b"".join(r[3] for r in rows), _U64)
    place = np.frombuffer(b"".join(r[4] for r in rows), np.int32).astype(np.int64)
    ids, comps, ns = (np.repeat(np.array([r[k] for r in rows], np.int64), counts) for k in range(3))
    order = np.argsort(token, kind="stable")
    token, place, ids, comps, ns = (x[order] for x in (token, place, ids, comps, ns))
    pairs = np.zeros((0, 2), np.int64)
    held: list[np.ndarray] = []
    left, far = np.arange(len(token)), 1
    while True:
        left = left[left + far < len(token)]
        left = left[token[left] == token[left + far]]
        if not len(left):
            break
        x, y = left, left + far
        need = (3 * (ns[x] + ns[y]) + 6) // 7  # shared shingles at similarity 0.75
        good = (comps[x] != comps[y]) & close(ns[x], ns[y]) & (np.minimum(ns[x] - place[x], ns[y] - place[y]) >= need)
        x, y = ids[x[good]], ids[y[good]]
        held.append(np.stack((np.maximum(x, y), np.minimum(x, y)), 1))
        far += 1
        if sum(map(len, held)) > 1 << 20:
            pairs, held = np.unique(np.concatenate((pairs, *held)), axis=0), []
    pairs = np.unique(np.concatenate((pairs, *held)), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The meetings of each part of rows that come sorted by part."""
    now, held = None, []
    for b in batches:
        for part, *row in zip(*(b.column(k).to_pylist() for k in range(len(_RARE))), strict=True):
            if part != now:
                if held:
                    yield _meetings(held)
                now, held = part, []
            held.append(tuple(row))
    if held:
        yield _meetings(held)


def leftover_links(bands: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links between classes of different components, among the classes of bands that hold several components."""
    members = bands.select("first", "class_id").distinct().join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    n = bands.count()
    members = materialize(members.withColumn("component", F.coalesce("component", "class_id")), "members", n)
    mixed = members.groupBy("first").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("first")
    apart = members.join(materialize(mixed, "mixed", n), "first").select("class_id", "component").distinct()
    apart = materialize(apart.join(classes.select("class_id", "doc_id", "text_hash", "n_shingles"), "class_id"), "apart", n)
    rare = apart.agg(F.sum(F.floor(F.col("n_shingles") / 4) + 1)).first()[0]
    if not rare:
        return apart.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    n = apart.count()
    texts = _texts(docs, apart, n)
    rows = few(texts.join(apart.select("class_id", "component"), "class_id").select("class_id", "component", "text"), n, TASK_TEXTS)
    counted = rows.mapInArrow(tidied(_count), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(COUNTERS, np.int64)
    frequency[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    parts = -(-rare // PART_SHINGLES)
    shared = docs.sparkSession.sparkContext.broadcast(frequency)
    found = rows.mapInArrow(tidied(_rarest(shared, parts)), "part int, class_id long, component long, n long, found binary, places binary")
    dealt = few(found.repartition("part"), parts, 1).sortWithinPartitions("part")
    pairs = materialize(dealt.mapInArrow(tidied(_meet), "a long, b long").distinct(), "meetings")
    likely = materialize(estimated(pairs, classes, pairs.count()), "likely")
    return confirmed(likely, texts, likely.count())


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """class_id and text of the wanted classes (class_id, doc_id, text_hash), of which there are at most so many, written once.

    A filter keeps most other texts from being shuffled; the join behind it is exact.
    """
    wanted = materialize(wanted.select("class_id", "doc_id", "text_hash").distinct(), "wanted", most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    own = own.where(sieve(wanted, "doc_id")(F.col("doc_id"))).withColumn("text_hash", F.xxhash64("text"))
    return materialize(own.join(wanted, ["doc_id", "text_hash"]).select("class_id", "text").dropDuplicates(["class_id"]), "texts", most, TASK_TEXTS)


def _one_document(full: DataFrame, grouped: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between the classes of one doc_id that has several texts; full has n rows at most."""
    several = full.groupBy("doc_id").agg(F.min("set_hash").alias("least"), F.max("set_hash").alias("most")).where("least <> most")
    several = materialize(several.select("doc_id", "least"), "several", n)
    of = lambda name, key: grouped.select(F.col("set_hash").alias(key), F.col("class_id").alias(name))
    each = full.select("doc_id", "set_hash").join(several, "doc_id").distinct()
    return each.join(of("a", "set_hash"), "set_hash").join(of("b", "least"), "least").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Texts are lower-cased (A-Z) and split at ASCII white space. Null texts and
    texts without words are linked with nothing. Equal sets are linked. Rows
    that repeat a doc_id are reported each; should their words differ, links of
    all of them count for the document. Rows without a doc_id are linked with nothing.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidied(_sign), _SIGNED_DDL), "signatures")
    full, n = signed.where("n_shingles > 0 and doc_id is not null"), signed.count()
    own = full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "sig")).alias("m"))
    grouped = materialize(own.select("set_hash", F.monotonically_increasing_id().alias("class_id"), "m.doc_id", "m.text_hash", "m.n_shingles", "m.sig"), "classes", n)
    classes = grouped.drop("set_hash")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS))))
    rows = classes.select("class_id", F.explode(keys).alias("band"))
    firsts = rows.groupBy("band").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last")).where("first < last")
    n_classes = classes.count()
    firsts = materialize(firsts.select("band", "first"), "firsts", BANDS * n_classes)
    rows = rows.where(sieve(firsts, "band")(F.col("band")))
    bands = materialize(rows.join(firsts, "band").select("band", "class_id", "first"), "bands", BANDS * n_classes)
    stars = bands.where("class_id <> first").select(F.col("class_id").alias("a"), F.col("first").alias("b")).distinct()
    stars = materialize(estimated(stars, classes, bands.count()), "stars")
    n_stars = stars.count()
    wanted = stars.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    texts = _texts(docs, wanted.join(classes, "class_id"), min(n_classes, 2 * n_stars))
    near = confirmed(stars.groupBy("a").agg(F.min("b").alias("b")), texts, min(n_classes, n_stars))
    links = materialize(near.unionByName(_one_document(full, grouped, n)), "links", n + n_classes)
    comps = materialize(components(links), "components", n_classes)
    later = materialize(_apart(stars, comps), "later", n_stars)
    if later.take(1):
        links = links.unionByName(materialize(confirmed(later, texts, later.count()), "links"))
        comps = materialize(components(links), "components", n_classes)
    left = materialize(leftover_links(bands, classes, comps, docs), "leftover")
    if left.take(1):
        links = links.unionByName(left)
        comps = materialize(components(links), "components", n_classes)
    linked = grouped.select("set_hash", "class_id", "doc_id").join(comps.withColumnRenamed("node", "class_id"), "class_id")
    least = materialize(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids", n_classes)
    named = linked.join(least, "component").select("set_hash", "component_id")
    of_class = grouped.select("set_hash", "doc_id").join(named, "set_hash", "left").select("set_hash", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = materialize(of_class, "class-components", n_classes)
    out = signed.join(of_class, (signed["set_hash"] == of_class["set_hash"]) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null("doc_id", component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document, that with the smallest doc_id, of each group of near duplicates; columns as given."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi").select(*docs.columns)
