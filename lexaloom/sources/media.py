"""Pictures of Office files as a table of their own, and where pages show them.

A file gives one row for each place where it shows a picture. Pictures are kept once,
by their SHA-256, however many files and pages show them; a page's image address
ends in that hash, so pages meet pictures, and pictures the files they came from, by
equi-joins. A picture that no page shows any more has no references left.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where kinds of files keep the parts that show pictures (in their order), and the pictures.
PARTS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide(\d+)\.xml", "xlsx": r"xl/drawings/drawing(\d+)\.xml"}
OPEN_DOCUMENT = ("odt", "odp", "ods")
FOLDER = "media"
#: Characters of text around an image.
AROUND = 80

MEDIA = "path string, at int, part int, name string, alt string, sha256 string, data binary"
_SHOWN = re.compile(r"""<(?:\w+:)?(?:docPr|cNvPr)\b([^>]*)>|<a:blip\b[^>]*?\br:(?:embed|link)="([^"]+)\"""")
_REL = re.compile(r"<Relationship\b[^>]*>")
_FRAME = re.compile(r"<draw:frame\b.*?</draw:frame>", re.S)


def _attribute(tag: str, name: str) -> str:
    m = re.search(rf"""\b{name}="([^"]*)\"""", tag)
    return unescape(m[1]) if m else ""


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The names of pictures by the ids that a part gives them."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    tags = _REL.findall(z.read(rels).decode("utf-8", "replace"))
    return {_attribute(t, "Id"): posixpath.normpath(posixpath.join(folder, _attribute(t, "Target"))).lstrip("/") for t in tags if "/image" in _attribute(t, "Type")}


def pictures(name: str, data: bytes) -> list[tuple[int, str, str, bytes]]:
    """Part (page or slide number, from 1), name, alternative text and bytes of each picture that a file shows, in order.

    What is no archive, or of another kind, shows none; a picture that is not in the archive is passed over.
    """
    kind = name.rsplit(".", 1)[-1].lower()
    out = []
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            names = set(z.namelist())
            if kind in OPEN_DOCUMENT and "content.xml" in names:
                for frame in _FRAME.findall(z.read("content.xml").decode("utf-8", "replace")):
                    target = _attribute(frame[frame.find("<draw:image") :], "xlink:href")
                    alt = re.search(r"<svg:(?:title|desc)>([^<]*)<", frame)
                    if target in names:
                        out.append((1, target, unescape(alt[1]) if alt else "", z.read(target)))
            elif kind in PARTS:
                found = [(int(m[1]) if m.groups() else 1, p) for p in names if (m := re.fullmatch(PARTS[kind], p))]
                for number, part in sorted(found):
                    targets, alt = _targets(z, part), ""
                    for m in _SHOWN.finditer(z.read(part).decode("utf-8", "replace")):
                        if m[2] is None:
                            alt = _attribute(m[1], "descr") or _attribute(m[1], "title")
                        elif targets.get(m[2]) in names:
                            out.append((number, targets[m[2]], alt, z.read(targets[m[2]])))
    except zipfile.BadZipFile:
        pass
    return out


def shown_media(files: DataFrame) -> DataFrame:
    """The columns of MEDIA for each picture that files (path, content binary) show; one file is read at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                rows = [(path, at, part, name, alt, hashlib.sha256(x).hexdigest(), x) for at, (part, name, alt, x) in enumerate(pictures(path, bytes(data or b"")))]
                yield pd.DataFrame(rows, columns=["path", "at", "part", "name", "alt", "sha256", "data"])

    return files.select("path", "content").mapInPandas(run, MEDIA)


def address(sha256, name):
    """The address that pages use for a picture (columns)."""
    return F.concat(F.lit(f"{FOLDER}/"), F.substring(sha256, 1, 32), F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))


def addressed(shown: DataFrame) -> DataFrame:
    """shown with url: one address for equal pictures, whatever their files call them."""
    first = shown.groupBy("sha256").agg(F.min("name").alias("first"))
    return shown.join(first, "sha256").withColumn("url", address(F.col("sha256"), F.col("first"))).drop("first")


def media_table(shown: DataFrame) -> DataFrame:
    """url, sha256, data and n_files of each distinct picture of rows of shown_media()."""
    # one of equal bytes; the hash is computed from them
    each = shown.groupBy("sha256").agg(F.min("name").alias("name"), F.any_value("data").alias("data"), F.count_distinct("path").alias("n_files"))
    return each.select(address(F.col("sha256"), F.col("name")).alias("url"), "sha256", "data", "n_files")


def image_section(shown: DataFrame) -> DataFrame:
    """path and section: Markdown that shows a file's pictures in order, under headings of their parts if there are several."""
    line = F.concat(F.lit("!["), F.regexp_replace("alt", r"[\[\]\r\n]+", " "), F.lit("]("), F.col("url"), F.lit(")"))
    parts = addressed(shown.drop("data")).groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    each = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "lines"))).alias("parts"))
    headed = F.transform("parts", lambda p: F.when(F.size("parts") > 1, F.concat(F.lit("### "), p["part"].cast("string"), F.lit("\n"), p["lines"])).otherwise(p["lines"]))
    return each.select("path", F.concat(F.lit("## Images\n\n"), F.array_join(headed, "\n\n"), F.lit("\n")).alias("section"))


def page_images(pages: DataFrame) -> DataFrame:
    """path, at (from 0), alt, url, before and after of each image in pages (path, content): up to AROUND characters of the text on either side."""
    image = r"!\[([^\]]*)\]\(([^\s)]+)(?:\s+\"[^\"]*\")?\)"
    texts = F.split(F.col("content"), image)
    tags = F.regexp_extract_all("content", F.lit(image), F.lit(0))
    own = pages.select("path", texts.alias("texts"), F.posexplode(tags).alias("at", "tag"))
    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    before, after = flat(F.get("texts", F.col("at"))), flat(F.get("texts", F.col("at") + 1))
    return own.select(
        "path", "at", F.trim(F.regexp_extract("tag", image, 1)).alias("alt"), F.regexp_extract("tag", image, 2).alias("url"),
        F.when(F.length(before) > AROUND, F.substr(before, F.length(before) - AROUND + 1)).otherwise(before).alias("before"), F.substring(after, 1, AROUND).alias("after"),
    )


def image_results(pages: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows of page_images() whose picture is known, with sha256, source (the first file by name that shows it) and n_files."""
    of = addressed(shown.select("sha256", "name", "path")).groupBy("url", "sha256").agg(F.min("path").alias("source"), F.count_distinct("path").alias("n_files"))
    return page_images(pages).join(of, "url").select("path", "at", "alt", "url", "before", "after", "sha256", "source", "n_files")


def references(pages: DataFrame, shown: DataFrame) -> DataFrame:
    """url, n_pages and n_places of each known picture; those with none may be removed."""
    uses = page_images(pages).groupBy("url").agg(F.count_distinct("path").alias("n_pages"), F.count(F.lit(1)).alias("n_places"))
    known = addressed(shown.select("sha256", "name")).select("url").distinct()
    return known.join(uses, "url", "left").select("url", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_places", F.lit(0)).alias("n_places"))
