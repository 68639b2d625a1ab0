"""The link pass: plain mentions of page titles become links, over all pages at once.

A target's terms are its slug and its title. A term can only stand in a page
that has its first two words one after another (or its only word; of a term with
Han, Kana or Hangul, its first such character), so pages and terms meet by that
key and the catalog of terms is never sent whole to any task. Each page then has
its own candidates, made a trie that one walk over the page's editable text
follows: at every place the longest term wins, then the smaller slug, and a
target is linked once. Front matter, code and links are not edited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that are no targets, links added to a page at most, least letters of a term (with and without CJK).
STRUCTURAL = ["index", "log", "overview", "purpose", "schema"]
MOST_LINKS = 15
LEAST_CJK, LEAST = 2, 3

_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
_WORDS = r"[\p{L}\p{N}]+"
_FRONT = re.compile(r"\A---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_KEPT = re.compile(r"```.*?```|`[^`\n]+`|\[\[[^\]\n]+(?:\|[^\]\n]*)?\]\]", re.S)
_HAS_CJK = re.compile("[⺀-⿟々〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺヽ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟᄀ-ᇿㄱ-ㆎ가-힣\U00020000-\U000323af]")


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORDS})"))


def term_catalog(pages: DataFrame) -> DataFrame:
    """slug, term and key of every term of every page that may be linked; pages: slug, title.

    Structural pages and terms of fewer than LEAST letters (LEAST_CJK with CJK) are left out.
    """
    named = pages.where((F.trim("slug") != "") & ~F.lower("slug").isin(STRUCTURAL))
    both = named.select(F.trim("slug").alias("slug"), F.explode(F.array("slug", "title")).alias("term")).select("slug", F.trim("term").alias("term"))
    cjk = F.col("term").rlike(_CJK)
    size = F.length(F.regexp_replace("term", r"\s+", ""))
    both = both.where(F.when(cjk, size >= LEAST_CJK).otherwise(size >= LEAST)).dropDuplicates(["slug", "term"])
    runs = _runs(F.col("term"))
    key = F.when(cjk, F.regexp_extract(F.lower("term"), f"({_CJK})", 1)).otherwise(F.array_join(F.slice(runs, 1, 2), " "))
    return both.select("slug", "term", key.alias("key"))


def page_keys(pages: DataFrame) -> DataFrame:
    """path and each key that a term of the page's text can have; pages: path, content. A term without a word has the empty key."""
    runs = pages.select("path", F.lower("content").alias("low")).withColumn("runs", _runs(F.col("low")))
    pairs = F.transform("runs", lambda w, k: F.array_join(F.slice(F.col("runs"), k + 1, F.lit(2)), " "))
    cjk = F.regexp_extract_all("low", F.lit(f"({_CJK})"))
    return runs.select("path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "runs", pairs, cjk))).alias("key"))


def _lower(text: str) -> str:
    """text in lower case, as long as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalnum()


def _trie(terms: list[tuple[str, str]]) -> dict:
    """Nested by character; under "" the slugs of a term and whether it has CJK."""
    root: dict = {}
    for slug, term in sorted(set(terms)):
        node = root
        for c in _lower(term):
            node = node.setdefault(c, {})
        node.setdefault("", ([], _HAS_CJK.search(term) is not None))[0].append(slug)
    return root


def _longest(trie: dict, low: str, start: int, stop: int, linked: set[str]) -> tuple[int, str] | None:
    """The end and slug of the longest term at start of whose target there is no link yet."""
    node, found = trie, None
    before = start > 0 and _is_word(low, start - 1)
    for at in range(start, stop):
        node = node.get(low[at])
        if node is None:
            break
        if "" in node:
            slugs, cjk = node[""]
            if cjk or not before and not (at + 1 < stop and _is_word(low, at + 1)):
                slug = next((s for s in slugs if s.lower() not in linked), None)
                if slug is not None:
                    found = at + 1, slug
    return found


def link_text(content: str, terms: list[tuple[str, str]], own: str, most: int = MOST_LINKS) -> tuple[str, int]:
    """content with links to the slugs of terms (slug, term), and how many were added; own: the page's slug, to which it does not link."""
    trie = _trie([(s, t) for s, t in terms if s.lower() != own.lower()])
    front = _FRONT.match(content)
    out, done, added, linked = [], 0, 0, set()
    start = front.end() if front else 0
    if not trie or not content[start:].strip():
        return content, 0
    pieces = [(m.start(), m.end()) for m in _KEPT.finditer(content, start)] + [(len(content), len(content))]
    for kept, after in pieces:
        segment, low = content[start:kept], _lower(content[start:kept])
        at = 0
        while at < len(segment) and added < most:
            found = _longest(trie, low, at, len(segment), linked) if low[at] in trie else None
            if found is None:
                at += 1
                continue
            end, slug = found
            shown = segment[at:end]
            out += [content[done : start + at], f"[[{slug}]]" if shown == slug else f"[[{slug}|{shown}]]"]
            done, at, added = start + end, end, added + 1
            linked.add(slug.lower())
        start = after
    return "".join([*out, content[done:]]), added


def link_pages(pages: DataFrame, targets: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """path, content and n_added of every page after the pass; pages: path (distinct), content; targets: slug, title.

    A null content has none added. Other columns are not read.
    """
    texts = pages.select("path", F.col("content").cast("string").alias("content"))
    met = page_keys(texts.where("content IS NOT NULL")).join(term_catalog(targets), "key").select("path", F.struct("slug", "term").alias("term")).distinct()
    own = met.groupBy("path").agg(F.collect_list("term").alias("terms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for path, content, terms in zip(b["path"], b["content"], b["terms"], strict=True):
                slug = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1], flags=re.I)
                made.append(link_text(content, [(t["slug"], t["term"]) for t in terms], slug, most) if content and terms is not None else (content, 0))
            yield pd.DataFrame({"path": b["path"], "content": [m[0] for m in made], "n_added": [m[1] for m in made]})

    return texts.join(own, "path", "left").mapInPandas(run, "path string, content string, n_added long")
