"""JSON objects inside of what a language model returns, found and read without trust.

A text is cut into runs of plain characters, escapes, quotes and braces, and one
fold over them keeps the place, the depth of braces and whether a string is open;
the first object ends where the depth is zero again. What is found is parsed as a
VARIANT, so a value of another type than expected is seen as that and left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def first_object(text: Column, escapes: str = "anywhere") -> Column:
    """The first balanced ``{...}`` of text, or null if none is closed.

    Braces inside of double quotes do not count. escapes: a backslash takes the
    next character's meaning "anywhere" behind the first brace, or only in "strings".
    """
    tail = F.substr(text, F.greatest(F.instr(text, "{"), F.lit(1)))
    tokens = F.regexp_extract_all(tail, F.lit(r'(?s)[^\\"{}]+|\\.|["{}]|\\'), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("stop"))

    def step(s: Column, t: Column) -> Column:
        mark = t
        if escapes == "strings":  # outside of strings the character behind a backslash is itself
            mark = F.when(~s["quoted"] & t.startswith("\\") & (F.length(t) == 2), F.substr(t, F.lit(2), F.lit(1))).otherwise(t)
        quoted = F.when(mark == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = F.when(s["quoted"], s["depth"]).when(mark == "{", s["depth"] + 1).when(mark == "}", s["depth"] - 1).otherwise(s["depth"])
        at = s["at"] + F.length(t)
        closed = (s["stop"] == 0) & ~s["quoted"] & (mark == "}") & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), F.when(closed, at).otherwise(s["stop"]).alias("stop"))

    stop = F.aggregate(tokens, start, step, lambda s: s["stop"])
    return F.when(F.instr(text, "{") > 0, F.transform(F.array(stop), lambda n: F.when(n > 0, F.substr(tail, F.lit(1), n)))[0])


def fenced_object(text: Column) -> Column:
    """The first balanced object of text without a code fence around it, or an empty text."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", "")
    return F.coalesce(first_object(F.regexp_replace(bare, r"(?i)\s*```\s*$", ""), "strings"), F.lit(""))


def _of_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _text(value: Column, path: str) -> Column:
    """A string at path, or null if there is none or it is of another type."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(_of_kind(found, "STRING"), F.try_variant_get(value, path, "string"))


def _list(value: Column, path: str) -> Column:
    """The elements of a list at path; none if it is no list."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(value: Column, path: str) -> Column:
    """The strings of a list at path."""
    return F.transform(F.filter(_list(value, path), lambda x: _of_kind(x, "STRING")), lambda x: x.cast("string"))


def resolved_ids(text: Column) -> Column:
    """The distinct strings of ``{"resolved": [...]}``."""
    return F.array_distinct(_texts(F.try_parse_json(fenced_object(text)), "$.resolved"))


def link_entries(text: Column) -> Column:
    """term and target of ``{"links": [{"term": ..., "target": ...}]}``, where both are strings and not empty."""
    rows = F.transform(_list(F.try_parse_json(fenced_object(text)), "$.links"), lambda x: F.struct(_text(x, "$.term").alias("term"), _text(x, "$.target").alias("target")))
    return F.filter(rows, lambda r: (r["term"] != "") & (r["target"] != ""))


def duplicate_groups(text: Column) -> Column:
    """slugs, canonical_slug, reason, confidence and contradictory of the groups of two slugs or more in ``{"groups": [...]}``.

    The canonical slug is the first one if none of the group's is named; a confidence that is neither high nor medium is low.
    """
    def one(g: Column) -> Column:
        slugs, named, sure = _texts(g, "$.slugs"), _text(g, "$.canonicalSlug"), _text(g, "$.confidence")
        flag = F.try_variant_get(g, "$.contradictory", "variant")
        return F.struct(
            slugs.alias("slugs"), F.when(F.array_contains(slugs, named), named).otherwise(F.get(slugs, F.lit(0))).alias("canonical_slug"),
            F.coalesce(_text(g, "$.reason"), F.lit("")).alias("reason"), F.when(sure.isin("high", "medium"), sure).otherwise("low").alias("confidence"),
            (_of_kind(flag, "BOOLEAN") & F.coalesce(F.try_variant_get(g, "$.contradictory", "boolean"), F.lit(False))).alias("contradictory"),
        )

    groups = F.transform(_list(F.try_parse_json(first_object(text)), "$.groups"), one)
    return F.filter(groups, lambda g: F.size(g["slugs"]) > 1)
