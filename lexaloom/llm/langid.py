"""Language identification with error-correcting output codes.

Each learned language has a codeword of bits. For every bit a binary n-gram
classifier tells the languages with a 1 from those with a 0: its weights are
log ratios of the mean n-gram distributions of the two sides, over hashed byte
n-grams of the lower-cased text. A document's mean weight under a classifier,
in units of the gap between the two sides' expectations, is the bit's margin.
Loss-weighted decoding adds up, for every codeword, the logistic losses of its
bits at these margins, each weighted by its classifier's gap, and takes the
codeword with the least loss. The score compares the best two; a document
whose best two codewords are nearly as good is flagged ambiguous.

N-grams are counted over all labelled documents, in parallel; only sums by
language and bucket (languages x BUCKETS rows, whatever the input's size) reach
the driver, and the weights (BUCKETS x bits) are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import batch, tidied

BUCKETS, ORDERS = 1 << 15, (1, 2, 3, 4)
#: Below this score the two best codewords count as equally near.
AMBIGUOUS = 0.02
#: accept() drops texts with a score below this one. It is lower than AMBIGUOUS, as texts in two languages are no junk.
REJECTED = 0.005
#: accept() does not judge ambiguity on texts with fewer n-grams: one or two words are often good in several languages.
FEWEST_NGRAMS = 400
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def histogram(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text by bucket; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    data = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    out = np.zeros(BUCKETS, np.int64)
    most = max(ORDERS)
    for start in range(0, len(data), STRETCH):
        x = np.frombuffer(data[start : start + STRETCH + most - 1], np.uint8).astype(np.uint32)
        code = np.zeros(len(x), np.uint32)
        for n in range(1, most + 1):
            if len(x) < n:
                break
            code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
            if n in ORDERS:
                fresh = code[: min(len(code), STRETCH)]
                h = (fresh ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
                out += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found = histogram(text.as_py())
            if found is not None:
                if lang in sums:
                    sums[lang] += found
                else:
                    sums[lang] = found
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    for lang, v in sums.items():
        at = np.flatnonzero(v)
        yield batch(schema, [lang] * len(at), at.astype(np.int32), v[at])


def codewords(n: int, seed: int = 6) -> np.ndarray:
    """A matrix of -1 and 1 with a row for each of n languages.

    Up to six languages have every way to tell them apart in two; more have
    15 ceil(log2 n) columns, of many random codes the one with the largest least distance.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        rest = [c for k in range(1, n) for c in combinations(range(1, n), k)]
        return np.array([[1 if i in c else -1 for c in rest] for i in range(n)], float)
    bits, rng = 15 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        same = code @ code.T - 2 * bits * np.eye(n)
        if bits - same.max() > far:
            best, far = code, bits - same.max()
    return best


class Model:
    """Languages, their codewords, and a weight column and gap for each bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1]) if langs else counts
        weights, middle, half = [], [], []
        for bit in self.code.T:
            up, down = p[bit > 0].mean(0), p[bit < 0].mean(0)
            w = np.log(up) - np.log(down)
            weights.append(w)
            expected = p @ w
            hi, lo = expected[bit > 0].min(), expected[bit < 0].max()
            middle.append((hi + lo) / 2)
            half.append(max((hi - lo) / 2, 1e-6))
        self.weights = np.array(weights, np.float32).reshape(-1, counts.shape[1]).T.copy()
        self.middle, self.half = np.array(middle), np.array(half)
        self.share = self.half / self.half.sum() if len(half) else self.half

    def predict(self, found: np.ndarray | None) -> tuple[str, float, bool]:
        """Language, score and whether the choice is ambiguous."""
        if found is None or not self.langs:
            return "und", 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margins = ((found @ self.weights) / found.sum() - self.middle) / self.half
        losses = (self.share * np.logaddexp(0, -2 * self.code * np.clip(margins, -30, 30))).sum(1)
        order = np.argsort(losses, kind="stable")
        score = float(np.clip(1 - losses[order[0]] / losses[order[1]], 0, 1))
        return self.langs[order[0]], score, score < AMBIGUOUS


def fit(labelled: DataFrame) -> Model:
    """Learn from the text and lang of all rows given, of which those without lang or letters teach nothing."""
    sums = (
        labelled.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(tidied(_count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    rows = sums.toArrow()
    names = np.array(rows.column("lang").to_pylist(), object)
    langs = sorted(set(names.tolist()))
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        counts[np.searchsorted(langs, names), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, counts)


_PREDICTED_DDL = "lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row, from text alone; `und` for a null text or one without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(histogram(t.as_py())) for t in b.column(1)]
            yield batch(schema, b.column(0), *(list(c) for c in zip(*found, strict=True))) if found else batch(schema, b.column(0), [], [], [])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), f"doc_id long, {_PREDICTED_DDL}")


def held_out(doc_id: str = "doc_id"):
    """Documents that never teach: a quarter, by a checksum of the id. A row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row, learned from the rows that are not held out.

    Repeated rows are predicted each; an empty table gives an empty result;
    without labelled rows everything is `und`. Other columns are not read.
    """
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def accept(docs: DataFrame) -> DataFrame:
    """docs without the rows that language identification rejects; columns as given.

    These are the rows without a letter and those whose best two languages are as good as each other (a score
    below REJECTED) in spite of at least FEWEST_NGRAMS n-grams. Without labelled rows only the former go.
    """
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.withColumn("text", F.col("text").cast("string"))
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = []
            for t in b.column(at):
                found = histogram(t.as_py())
                keep.append(found is not None and not (m.langs and m.predict(found)[1] < REJECTED and found.sum() >= FEWEST_NGRAMS))
            yield b.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(tidied(run), plain.schema)
