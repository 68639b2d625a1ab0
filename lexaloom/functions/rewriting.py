"""Changes to page texts: front matter fields, links, and entries of index and log pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaloom.functions import markup as M
from lexaloom.functions import text as T

_BLOCK = r"^(---\r?\n)((?s:.*?))(\r?\n---)"

# Characters kept free of a context for the prompt and for each stage's answer, the least chunk, and the context if none is set.
PROMPT_CHARS, ANALYSIS_CHARS, GENERATION_CHARS, LEAST_CHUNK, CONTEXT_CHARS = 12_000, 16_000, 32_000, 10_000, 200_000


def literal(text: Column) -> Column:
    """text as a replacement in regexp_replace."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _field(content: Column, line: Column, places: list[str]) -> Column:
    """content with the first of the patterns that occurs in its front matter replaced by line, or line at the end; without front matter as it is."""
    whole, opening, fields, closing = (F.regexp_extract(content, _BLOCK, k) for k in range(4))
    new = F.concat(fields, F.lit("\n"), line)
    for place in reversed(places):
        first = rf"^((?s:.*?))(?m:{place})"
        new = F.when(fields.rlike(rf"(?m){place}"), F.regexp_replace(fields, first, F.concat(F.lit("$1"), literal(line)))).otherwise(new)
    return F.when(whole == "", content).otherwise(F.concat(opening, new, closing, F.substr(content, F.length(whole) + 1)))


def with_array(content: Column, name: str, values: Column) -> Column:
    """content with a list field as one line of quoted items: in the place of an inline list (up to the line's last bracket, so that its items may be links), one over several lines or a block list, else as the last field.

    The line end behind a block list stays, so that the next field keeps a line of its own.
    """
    key = re.escape(name)
    line = F.concat(F.lit(f"{name}: ["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))
    return _field(content, line, [rf"^{key}:[ \t]*\[.*\][ \t]*$", rf"^{key}:\s*\[[^\]]*\]", rf"^{key}:[ \t]*(?:\r?\n[ \t]*-[ \t]+.+)+"])


def with_scalar(content: Column, name: str, value: Column) -> Column:
    """content with a scalar field replaced, else as the last field; list fields are not scalars."""
    return _field(content, F.concat(F.lit(f"{name}: "), value), [rf"^{re.escape(name)}:[ \t]*(?![\[ \t\r\n])[^\r\n]*"])


def with_source(content: Column, source: Column) -> Column:
    """content whose sources hold source, equal but for case; unchanged if they do or if source is blank."""
    own, name = T.array_field(content, "sources"), F.trim(source)
    there = F.exists(own, lambda s: F.lower(s) == F.lower(name))
    return F.when((name == "") | there, content).otherwise(with_array(content, "sources", F.concat(own, F.array(name))))


def relinked(content: Column, moves: Column) -> Column:
    """content whose links to old pages lead to new ones; moves: array of (old, new)."""
    to = lambda t, m, end: F.replace(t, F.concat(F.lit("[["), m["old"], F.lit(end)), F.concat(F.lit("[["), m["new"], F.lit(end)))
    return F.aggregate(moves, content, lambda t, m: to(to(t, m, "]]"), m, "|"))


def without_mentions(index: Column, slugs: Column) -> Column:
    """Index text without lines that link to one of the slugs, as wiki or Markdown links."""
    refs = lambda l: F.concat(
        F.regexp_extract_all(l, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), F.regexp_extract_all(l, F.lit(r"\]\((?:[^)]*/)?([^)/]+)\.md\)"), F.lit(1))
    )
    return F.array_join(F.filter(F.split(index, "\n"), lambda l: ~F.arrays_overlap(refs(l), slugs)), "\n")


def _trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def index_entry(target: Column, description: Column, title: Column) -> Column:
    """A list line of an index: link, shown title if it is another one, and description."""
    plain = F.trim(F.regexp_replace(target, r"^\[\[|\]\]$", ""))
    about = F.coalesce(F.nullif(F.trim(description), F.lit("")), F.lit("(no description)"))
    shown = F.when(title.isNotNull() & (title != "") & (title != plain), F.concat(F.lit("|"), title)).otherwise("")
    return F.concat(F.lit("- [["), plain, shown, F.lit("]] — "), about)


def with_index_entry(index: Column, section: Column, entry: Column) -> Column:
    """index with an entry right under its section's header; a missing section comes last."""
    header, line = F.concat(F.lit("## "), section), F.trim(entry)
    at = F.position(F.concat(header, F.lit("\n")), index)
    end = at + F.length(header)
    inside = F.concat(F.substr(index, F.lit(1), end), line, F.lit("\n"), F.substr(index, end + 1))
    new = F.concat(_trim_end(index), F.lit("\n\n"), header, F.lit("\n"), line, F.lit("\n"))
    return F.when(line == "", index).when(at > 0, inside).when(F.contains(index, header), index).otherwise(new)


def with_log_entry(log: Column, entry: Column) -> Column:
    """log with an entry at its end, behind an empty line."""
    base = _trim_end(log)
    return F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("\n\n"))), F.regexp_replace(entry, r"^\s+|\s+$", ""), F.lit("\n"))


def chapter_slug(number: Column, title: Column) -> Column:
    """`chNN-` and a slug of at most 50 ASCII word characters, of a chapter numbered from 0."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_\s-]", ""), r"\s+", "-")
    slug = F.substring(F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-|-$", ""), 1, 50)
    digits = (number + 1).cast("string")
    return F.concat(F.lit("ch"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits), F.lit("-"), F.when(slug == "", "chapter").otherwise(slug))


def chunk_budgets(context: Column) -> Column:
    """Characters for one analysis and one generation call, given the characters of a context (null or none: the default)."""
    size = F.when(context > 0, context).otherwise(CONTEXT_CHARS)
    left = lambda answer: F.greatest(F.lit(LEAST_CHUNK), size - PROMPT_CHARS - answer)
    return F.struct(left(ANALYSIS_CHARS).alias("analysis"), left(GENERATION_CHARS).alias("generation"))


def lint_blocks(text: Column) -> Column:
    """type, severity, title and body of blocks between `---LINT: type | severity | title---` and `---END LINT---`."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)---LINT:[^\n|]+\|[^\n|]+\|[^\n]+?---\n.*?---END LINT---"), F.lit(0))
    part = lambda b, k: F.trim(F.regexp_extract(b, r"(?s)^---LINT:([^\n|]+)\|([^\n|]+)\|([^\n]+?)---\n(.*?)---END LINT---$", k))
    body = lambda b: F.regexp_replace(part(b, 4), r"^\s+|\s+$", "")
    return F.transform(found, lambda b: F.struct(F.lower(part(b, 1)).alias("type"), F.lower(part(b, 2)).alias("severity"), part(b, 3).alias("title"), body(b).alias("body")))


def trimmed_index(index: Column, tokens: list[str], budget: int) -> Column:
    """An index over budget cut to its headers and the lines that hold a token, each kept if it still fits; a note says so."""
    lines = F.filter(F.split(index, "\n"), lambda l: l.startswith("##") | (T.contains_count(F.lower(l), tokens) > 0))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("kept"))
    step = lambda s, l: F.when(
        s["n"] + F.length(l) + 1 <= budget, F.struct((s["n"] + F.length(l) + 1).alias("n"), F.concat(s["kept"], F.lit("\n"), l).alias("kept"))
    ).otherwise(s)
    kept = F.substr(F.aggregate(lines, start, step)["kept"], F.lit(2))
    return F.when(F.length(index) > budget, F.concat(kept, F.lit("\n\n[...index trimmed to relevant entries...]"))).otherwise(index)


def related_slugs(content: Column) -> Column:
    """What the related field leads to: targets of whole links, other items as they are."""
    return F.transform(T.array_field(content, "related"), M.link_slug)


def references(content: Column) -> Column:
    """Every page that content leads to, by links or its related field."""
    return F.concat(T.link_targets(content), related_slugs(content))
