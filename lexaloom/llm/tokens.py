"""Tokenizer access inside tasks: whole texts to ids, exactly as the tokenizer itself gives them.

A byte-level BPE splits a text into pieces before it merges, and a single space
before a visible character always starts a piece. Texts are therefore cut there
into units, and Arrow lists the distinct units of a batch of texts: prose repeats
its words, so a unit is encoded once and its ids are put in place by position.
Latin letters are one piece, which the tokenizer's BPE model takes as it is, and
so are the marks and the line end behind them; Arrow takes units apart into such
pieces and lists the distinct ones. Units of another form go through the whole
tokenizer. Ids of pieces are kept between batches.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept in each of two generations by a Python worker (about 100 bytes each).
CACHE_UNITS = 200_000
#: Longer units are encoded but not kept.
LONGEST_UNIT = 64
#: Characters that are cut together, and units whose ids are put in place together.
TOGETHER, PLACED = 1 << 23, 1 << 19
#: Words whose tokens are held together; few enough not to call for garbage collection.
MODEL_WORDS = 1 << 8

#: Where a text may be cut, and a space where it may not.
_CUT = re.compile(" (?=[!-~¡-ᙿ])")
_ODD = re.compile(" (?![!-~¡-ᙿ])")
#: A word with marks behind it, and perhaps one more on the next line; these are letters in every version of Unicode.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", "[!-/:-@\\[-`{-~]*"
_PIECES = f"\\A(?P<first>{_LETTERS})(?P<marks>{_MARKS})(?:\n(?P<second>{_LETTERS})(?P<last>{_MARKS}))?\\z"


def _bytes_of_units() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _stretches(text: str) -> list[str]:
    """text in parts of at most about TOGETHER characters, each of which is encoded as if alone."""
    out, start = [], 0
    while len(text) - start > TOGETHER:
        m = _CUT.search(text, start + TOGETHER)
        if m is None:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def _strings(found: pa.Array) -> list[str]:
    """The strings of an array without nulls; by way of an object array, as a scalar for each one takes longer."""
    return found.to_numpy(zero_copy_only=False).tolist()


def _gathered(data: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the coded pieces one after another; data has those of all pieces, sizes how many each has."""
    starts = np.cumsum(sizes) - sizes
    placed = [data[:0]]
    for at in range(0, len(codes), PLACED):
        own = codes[at : at + PLACED]
        n = sizes[own]
        ends = np.cumsum(n)
        placed.append(data[np.repeat(starts[own] - ends + n, n) + np.arange(ends[-1])])
    return np.concatenate(placed)


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        alphabet = _bytes_of_units()
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token) if all(c in alphabet for c in token) else len(token.encode())
        self.shown = {b: c for c, b in alphabet.items()}  # for str.translate of bytes read as Latin-1
        self.space = self.shown[32]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made["pre_tokenizer"] or {}
        #: Whether a space and letters are one piece, given to the model byte by byte.
        self.direct = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        self.line = self._whole("\n")
        self.marks: dict[str, bytes] = {"": b""}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _shown(self, word: str) -> str:
        """Letters with the space before them (a line end before them is a piece of its own) in the byte-level alphabet."""
        shown = word[1:].encode().decode("latin-1").translate(self.shown)
        return shown if word[0] == "\n" else self.space + shown

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of letters, each with the space or line end before them."""
        young, old, space, shown = self.young, self.old, self.space, self._shown
        found = [*map(young.get, words)]
        new: list[int] = []
        for at, ids in enumerate(found):
            if ids is None:
                word = words[at]
                ids = old.get(word)
                if ids is None:
                    new.append(at)
                else:
                    found[at] = young[word] = ids
        for first in range(0, len(new), MODEL_WORDS):
            own = [words[at] for at in new[first : first + MODEL_WORDS]]
            made = [*map(self.model.tokenize, [space + w[1:] if w[0] == " " and w.isascii() else shown(w) for w in own])]
            data, start = np.array([t.id for x in made for t in x], "<u4").tobytes(), 0
            for at, word, x in zip(new[first : first + MODEL_WORDS], own, made, strict=True):
                end = start + 4 * len(x)
                ids = found[at] = data[start:end]
                start = end
                if len(word) <= LONGEST_UNIT:
                    young[word] = ids
        return found

    def _marks(self, marks: str) -> bytes:
        """The ids of marks alone."""
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._whole(marks)
            if len(marks) < 8:
                self.marks[marks] = ids
        return ids

    def _keep(self, units: list[str]) -> None:
        """Keep the ids of units, each preceded by its space; they are told apart by the bytes that ids stand for."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        at = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "left") + 1
        data, start = ids.tobytes(), 0
        for u, end in zip(units, at.tolist(), strict=True):
            self.young[u] = data[4 * start : 4 * end]
            start = end

    def _pieces(self, found: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that are letters, marks and perhaps one more line, and how many each has."""
        first, marks, second, last = (found.field(name) for name in ("first", "marks", "second", "last"))
        more = np.flatnonzero(pc.not_equal(second, "").to_numpy(zero_copy_only=False))
        after = pa.array(more)
        led = lambda before, x: pc.binary_join_element_wise(pa.scalar(before, x.type), x, pa.scalar("", x.type))
        words = pa.concat_arrays([led(" ", first), led("\n", second.take(after))]).dictionary_encode()
        signs = pa.concat_arrays([marks, last.take(after)]).dictionary_encode()
        pieces = [b"", self.line, *self._words(_strings(words.dictionary)), *map(self._marks, _strings(signs.dictionary))]
        word = words.indices.to_numpy().astype(np.int64) + 2
        sign = signs.indices.to_numpy().astype(np.int64) + 2 + len(words.dictionary)
        n = len(found)
        own = np.zeros((n, 5), np.int64)
        own[:, 0], own[:, 1] = word[:n], sign[:n]
        own[more, 2], own[more, 3], own[more, 4] = 1, word[n:], sign[n:]
        sizes = np.array([len(x) for x in pieces], np.int64) // 4
        return _gathered(np.frombuffer(b"".join(pieces), "<u4"), sizes, own.ravel()), sizes[own].sum(axis=1)

    def _others(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units of any form, each preceded by its space."""
        young, old = self.young, self.old
        found: list[bytes | None] = []
        holes: list[int] = []
        for at, u in enumerate(units):
            ids = young.get(u)
            if ids is None and u in old:
                ids = young[u] = old[u]
            elif ids is None and len(u) > LONGEST_UNIT:
                ids = self._whole(" " + u)
            elif ids is None:
                holes.append(at)
            found.append(ids)
        if holes:
            self._keep([units[at] for at in holes])
            for at in holes:
                found[at] = young[units[at]]
        return found

    def _ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct units, each preceded by its space, how many each has, and the order in which they stand."""
        if len(self.young) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        plain = np.zeros(len(units), bool)
        if self.direct and len(units):
            found = pc.extract_regex(units, _PIECES)
            plain = pc.and_(pc.is_valid(found), pc.invert(pc.match_substring(units, "<|"))).to_numpy(zero_copy_only=False)
        other, order = np.flatnonzero(~plain), np.argsort(~plain, kind="stable")
        rest = self._others(_strings(units.take(pa.array(other))))
        data, sizes = np.frombuffer(b"".join(rest), "<u4"), np.array([len(x) // 4 for x in rest], np.int64)
        if plain.any():
            made, n = self._pieces(found.filter(pa.array(plain)))
            data, sizes = np.concatenate((made, data)), np.concatenate((n, sizes))
        return data, sizes, order

    def listed(self, units: list[str]) -> list[bytes]:
        """The ids of each of distinct units, preceded by its space."""
        data, sizes, order = self._ids_of(pa.array(units, pa.large_string()))
        ends, packed = 4 * np.cumsum(sizes), data.tobytes()
        out = [b""] * len(units)
        for at, start, end in zip(order.tolist(), (ends - 4 * sizes).tolist(), ends.tolist(), strict=True):
            out[at] = packed[start:end]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers.

        A longer text than TOGETHER is cut where a text may be cut, and its parts are encoded one by one.
        """
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for at, text in enumerate(texts):
            for part in _stretches(text):
                if size + len(part) > TOGETHER:
                    self._put(held, out)
                    held, size = [], 0
                held.append((at, part))
                size += len(part)
        self._put(held, out)
        return [found[0] if len(found) == 1 else np.concatenate(found) for found in out]

    def _put(self, held: list[tuple[int, str]], out: list[list[np.ndarray]]) -> None:
        for (at, _), ids in zip(held, self._together([t for _, t in held]), strict=True):
            out[at].append(ids)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of some texts."""
        if not texts:
            return []
        odd = [_ODD.search(t) is not None for t in texts]
        plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.large_string()), " ")
        other = [_CUT.split(t) for t, o in zip(texts, odd, strict=True) if o]
        order = np.argsort(odd, kind="stable")  # plain texts first
        counts = np.concatenate((pc.list_value_length(plain).to_numpy(zero_copy_only=False), [len(x) for x in other])).astype(np.int64)
        cut = pa.concat_arrays([plain.flatten(), pa.array([u for x in other for u in x], pa.large_string())]).dictionary_encode()
        codes, units = cut.indices.to_numpy().astype(np.int64), cut.dictionary
        heads = np.cumsum(counts) - counts
        first = [f.ids for f in self.tokenizer.encode_batch_fast(_strings(units.take(pa.array(codes[heads]))), add_special_tokens=False)]
        inner = np.ones(len(codes), bool)
        inner[heads] = False
        used = np.flatnonzero(np.bincount(codes[inner], minlength=len(units)))
        data, sizes, order_of = self._ids_of(units.take(pa.array(used)))
        place = np.zeros(len(units), np.int64)
        place[used[order_of]] = np.arange(len(used))
        codes = place[codes]
        codes[heads] = len(used) + np.arange(len(heads))
        sizes = np.concatenate((sizes, np.array([len(f) for f in first], np.int64)))
        data = np.concatenate((data, np.array([i for f in first for i in f], "<u4")))
        ids = _gathered(data, sizes, codes)
        ends = np.add.reduceat(sizes[codes], heads).cumsum() if len(heads) else heads
        out: list[np.ndarray] = [ids[:0]] * len(texts)
        for text, start, end in zip(order.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[text] = ids[start:end]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Give up the encoders of this Python worker, with the ids that they have kept; later stages have its memory."""
    _ENCODERS.clear()


def public_path(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary file lies; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)
