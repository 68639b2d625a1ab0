"""Page tables from files and from HTML."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.functions import text as T
from lexaloom.sources import office


def scan_pages(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, modified, size and content of the files under root; names that start with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(~F.col("path").rlike(r"/\.[^/]+")).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Fields of pages (path, content): id, title, type, tags, related, sources, links, images and body."""
    c, p = F.col("content"), F.col("path")
    return pages.select(
        "path", T.page_key(p).alias("id"), T.page_title(c, p).alias("title"), T.page_type(c).alias("type"),
        *[T.array_field(c, f).alias(f) for f in ("tags", "related", "sources")],
        T.link_targets(c).alias("links"), T.image_urls(c).alias("images"), T.body_of(c).alias("body"),
    )


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    """Distinct link addresses in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)))


_DROP = re.compile(r"(?is)<(script|style|nav|footer|head|noscript)\b.*?</\1\s*>|<!--.*?-->")
_RULES = [
    (re.compile(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), lambda m: f"\n\n{'#' * int(m[1])} {m[2].strip()}\n\n"),
    (re.compile(r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>"), lambda m: f"**{m[1].strip()}**"),
    (re.compile(r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)>"), lambda m: f"*{m[1].strip()}*"),
    (re.compile(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), lambda m: f"[{m[2].strip()}]({m[1]})"),
    (re.compile(r'(?is)<img\s[^>]*?src="([^"]*)"[^>]*>'), lambda m: f"![]({m[1]})"),
    (re.compile(r"(?i)<li\b[^>]*>"), lambda m: "\n- "),
    (re.compile(r"(?i)<br\s*/?>"), lambda m: "\n"),
    (re.compile(r"(?i)</?(?:p|div|section|article|ul|ol|table|tr|blockquote)\b[^>]*>"), lambda m: "\n\n"),
    (re.compile(r"<[^>]+>"), lambda m: ""),
]


_TAG = re.compile(r"<[^>]+>")
_CODE = re.compile(r"(?is)<pre\b[^>]*>(.*?)</pre>|<code\b[^>]*>(.*?)</code>")
_TABLE = re.compile(r"(?is)<table\b[^>]*>((?:(?!<table\b).)*?)</table>")


def markdown_of(html: str | None) -> str:
    """Markdown of a page's content, without scripts, styles and navigation; code keeps its lines, tables their cells."""
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match) -> str:
        plain = entities.unescape(_TAG.sub("", m[1] if m[1] is not None else m[2]))
        if m[1] is None:
            return keep(f"`{plain.strip()}`")
        body = plain.strip("\n")
        return "\n\n" + keep(f"```\n{body}\n```") + "\n\n"

    def prose(text: str) -> str:
        for pattern, new in _RULES:
            text = pattern.sub(new, text)
        return text

    def table(m: re.Match) -> str:
        rows = [[entities.unescape(prose(c)) for c in re.findall(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", m[1])]
        lines = office.table_lines(rows)
        return "\n\n" + keep("\n".join(lines)) + "\n\n" if lines else prose(m[1])

    text = _CODE.sub(code, _DROP.sub("", (html or "").replace("\x00", "")))
    text = prose(_TABLE.sub(table, text))
    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in entities.unescape(text).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    for k in reversed(range(len(kept))):  # a table may hold code, never the other way round
        text = text.replace(f"\x00{k}\x00", kept[k])
    return text


def clip_pages(pages: DataFrame) -> DataFrame:
    """page_id, title and content (Markdown) of HTML pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f["page_id"], "title": f["title"], "content": f["html"].map(markdown_of)})

    return pages.select("page_id", html_title(F.col("html")).alias("title"), "html").mapInPandas(run, "page_id long, title string, content string")


def file_text(path: str, data: bytes) -> str:
    """A file's text, by extension; other kinds have a placeholder."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in office.KINDS:
        return office.office_text(path, data)
    if ext in ("html", "htm"):
        return markdown_of(data.decode("utf-8", "replace"))
    if ext in ("md", "txt", "csv", "json", "yaml", "yml"):
        return data.decode("utf-8", "replace")
    return f"[{ext} file: {path.rsplit('/', 1)[-1]}]"


def extract_files(files: DataFrame) -> DataFrame:
    """path and content (text) of files (path, content binary)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "content": [file_text(p, bytes(d)) for p, d in zip(f["path"], f["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, content string")
