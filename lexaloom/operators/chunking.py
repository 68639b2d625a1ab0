"""Markdown chunking, fixed windows and ordered batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes in characters.
TARGET, MOST, LEAST, OVERLAP = 1000, 1500, 200, 200

CHUNK_DDL = "chunk_index int, chunk_text string, heading_path string, char_start int, char_end int, oversized boolean"

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"`{3,}|~{3,}")
#: Behind a sentence's end, and behind white space, where an overlap may begin.
_SENTENCE, _SPACE = re.compile(r"[。！？!?.;；]\s*"), re.compile(r"\s")
#: Separators from coarse to fine; text behind a separator starts a new piece.
_LEVELS = [re.compile(p) for p in (r"(?<=\n)", r"(?<=[.!?。！？])(?:(?<=[。！？])|\s+)", r"(?<=\s)")]


def fenced_after(line: str, mark: str) -> str:
    """The mark of the code block that is open behind a line, given the one open before it (empty: none).

    A block opens with three or more backticks or tildes in the first column and ends with the same mark alone on a line.
    """
    if mark:
        return "" if line.startswith(mark) and line.strip() == mark else mark
    found = _FENCE.match(line)
    return found[0] if found else ""


def snapped(tail: str) -> str:
    """The end of a chunk from its first whole sentence, else from its first whole word."""
    m = _SENTENCE.search(tail)
    if m and m.end() < len(tail):
        return tail[m.end() :]
    m = _SPACE.search(tail)
    return tail[m.end() :] if m and m.end() < len(tail) else tail


def sections(text: str) -> Iterator[tuple[str, int, str]]:
    """Heading path, start and text of each section; headings in fenced code do not count."""
    path: list[str] = []
    start = at = 0
    mark = ""
    for line in text.splitlines(keepends=True):
        inside, mark = mark, fenced_after(line, mark)
        m = None if inside or mark else _HEADING.match(line.rstrip("\r\n"))
        if m:
            if text[start:at].strip():
                yield " > ".join(p for p in path if p), start, text[start:at]
            depth = len(m[1])
            path = path[: depth - 1] + [""] * (depth - 1 - len(path)) + [m[2]]
            start = at
        at += len(line)
    if text[start:].strip():
        yield " > ".join(p for p in path if p), start, text[start:]


def atoms(text: str, start: int) -> Iterator[tuple[int, str, bool]]:
    """Start, text and whether it is whole (code or table) of a section's paragraphs."""
    lines, at, held, first, whole, mark = text.splitlines(keepends=True), start, [], start, False, ""
    for line in lines:
        inside, mark = mark, fenced_after(line, mark)
        fence, table = bool(mark), line.startswith("|")
        if inside:
            held.append(line)
            if not mark:
                yield first, "".join(held), True
                held = []
        elif fence or not line.strip() or (held and table != whole):
            if held:
                yield first, "".join(held), whole and len(held) > 1
            held, first, whole = ([line] if line.strip() else []), at, table
        else:
            if not held:
                first, whole = at, table
            held.append(line)
        at += len(line)
    if held:
        yield first, "".join(held), bool(mark) or (whole and len(held) > 1)


def cut(text: str, start: int, target: int, level: int = 0) -> Iterator[tuple[int, str]]:
    """Pieces of at most target characters: at lines, sentences, spaces, and in the last resort anywhere."""
    if len(text) <= target:
        yield start, text
        return
    if level == len(_LEVELS):
        for at in range(0, len(text), target):
            yield start + at, text[at : at + target]
        return
    ends = [m.end() for m in _LEVELS[level].finditer(text)]
    at = 0
    for end in [*ends, len(text)]:
        if end > at:
            yield from cut(text[at:end], start + at, target, level + 1)
            at = end


_FRONT = re.compile(r"---\r?\n.*?\r?\n---(?:\r?\n|$)", re.S)


def chunk_markdown(text: str, target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[str, str, int, int, bool]]:
    """Text, heading path, start, end and oversized of each chunk; places are in the whole text, of which the front matter is no part of a chunk.

    Code blocks and tables are not cut. Pieces are packed up to target; a chunk
    below least joins the one before if both stay within most. Each chunk but a
    section's first starts with the end of the one before, from a sentence's or else a word's
    start, and its place is that of the overlap.
    """
    most, overlap = max(most, target), overlap if overlap < target else target // 2
    out: list[tuple[str, str, int, int, bool]] = []
    front = _FRONT.match(text)
    before = front.end() if front else 0
    for path, start, body in sections(text[before:]):
        packed: list[list] = []
        for first, atom, whole in atoms(body, start + before):
            pieces = [(first, atom)] if whole else list(cut(atom, first, target))
            for at, piece in pieces:
                if packed and len(packed[-1][1]) + len(piece) <= target:
                    packed[-1][1:] = packed[-1][1] + piece, at + len(piece)
                else:
                    packed.append([at, piece, at + len(piece)])
        merged: list[list] = []
        for at, piece, end in packed:
            if merged and (len(piece) < least or len(merged[-1][1]) < least) and len(merged[-1][1]) + len(piece) <= most:
                merged[-1][1:] = merged[-1][1] + piece, end
            else:
                merged.append([at, piece, end])
        for k, (at, piece, end) in enumerate(merged):
            tail = snapped(merged[k - 1][1][-overlap:]) if k and overlap else ""
            out.append((tail + piece, path, at - len(tail), end, len(tail) + len(piece) > most))
    return out


def chunk_pages(pages: DataFrame, **sizes: int) -> DataFrame:
    """page_id with the columns of CHUNK_DDL for every chunk of pages (page_id, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (page, k, text, path, at, end, big)
                for page, content in zip(f["page_id"], f["content"], strict=True)
                for k, (text, path, at, end, big) in enumerate(chunk_markdown(content or "", **sizes))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "chunk_index", "chunk_text", "heading_path", "char_start", "char_end", "oversized"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "content").mapInPandas(run, f"page_id {kind}, {CHUNK_DDL}")


def windows(text: Column, size: int, overlap: int) -> Column:
    """An array of structs (start, text) of fixed windows that overlap."""
    n = F.length(text)
    last = F.greatest(n - overlap - 1, F.lit(0))
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def batches(items: DataFrame, group: str, name: str, order: str, size: int) -> DataFrame:
    """items with batch: within each group the first of names equal but for case stays, and size of them make a batch."""
    first = Window.partitionBy(group, F.lower(name)).orderBy(order)
    kept = items.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return kept.withColumn("batch", F.floor(at / size))
