"""Predicates and parts of file paths, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by category, and names that some file systems reserve.
CATEGORIES = {
    "markdown": "md mdx markdown", "text": "txt log rst org", "data": "csv tsv json yaml yml xml toml", "code": "py js ts rs go java c cpp h sh sql",
    "document": "pdf docx doc odt rtf", "slides": "pptx ppt odp", "sheet": "xlsx xls ods", "image": "png jpg jpeg gif webp svg bmp",
    "audio": "mp3 wav flac ogg m4a", "video": "mp4 mov mkv webm avi", "web": "html htm",
}
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
TEXT_CATEGORIES = ("markdown", "text", "data", "code", "web")
INGESTED = ("markdown", "text", "data", "document", "slides", "sheet", "web", "image")


def normalized(path: Column) -> Column:
    """Forward slashes, without repeated or trailing ones."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), "(?<=.)/$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normalized(path), "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def category(path: Column) -> Column:
    ext, out = extension(path), F.lit(None).cast("string")
    for name, exts in CATEGORIES.items():
        out = F.when(ext.isin(exts.split()), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def is_text(path: Column) -> Column:
    return category(path).isin(*TEXT_CATEGORIES)


def is_ingestable(path: Column) -> Column:
    """A source to read: a known kind, not hidden, not in a cache folder."""
    return category(path).isin(*INGESTED) & ~normalized(path).rlike(r"(^|/)\.")


def is_safe(path: Column) -> Column:
    """A relative path without parent steps, control or reserved characters, or reserved names."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    odd = path.rlike(r'[\x00-\x1f<>:"|?*]') | path.rlike(r"^[/\\]") | (path == "")
    return ~odd & ~F.exists(parts, lambda p: (p == "..") | p.rlike(RESERVED) | p.rlike(r"[ .]$"))


def folder_context(path: Column) -> Column:
    """The folders of a path as a trail."""
    parts = F.split(normalized(path), "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def safe_segment(name: Column) -> Column:
    """A file name that every system takes."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "-"), r"[ .]+$", "")
    return F.when(plain == "", "untitled").when(plain.rlike(RESERVED), F.concat(F.lit("_"), plain)).otherwise(plain)


def glob_pattern(glob: str) -> str:
    """A case-insensitive pattern for a glob of * and ?."""
    quoted = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else f"\\{c}" for c in glob)
    return f"(?i)^{quoted}$"


def matches_glob(path: Column, glob: str) -> Column:
    """Whether a glob fits the file name or the whole path."""
    p = glob_pattern(glob)
    return file_name(path).rlike(p) | normalized(path).rlike(p)


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def version_key(version: Column) -> Column:
    """Numbers of a version, comparable as an array."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def is_newer(a: Column, b: Column) -> Column:
    return version_key(a) > version_key(b)
