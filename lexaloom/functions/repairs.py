"""Ordered repair of page texts that a model has written: each rule mends one kind of damage, and all of them together change nothing the second time.

Rules stand in the order in which they rely on each other: marks of editors first,
then the lines around a front matter block, then what wraps it, then its fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaloom.functions import rewriting as R
from lexaloom.functions import text as T

#: The fields that a written block may have, and file endings of sources.
KEYS = "type|title|tags|related|sources|created|updated|description|origin|summary|status"
ENDINGS = r"(?i)\.(pdf|md|markdown|txt|docx?|html?|epub)$"
#: A name is whole if it is as long as this share of all fragments joined.
WHOLE = 0.9

_OPEN = r"\A---[ \t]*\r?\n"
_BLOCK = r"\A(---[ \t]*\r?\n)((?s:.*?))(\r?\n---[ \t]*(?:\r?\n|\z))"


def _all(*rules: tuple[str, str]):
    return lambda c: reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, c)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _unless_open(change):
    return lambda c: F.when(c.rlike(_OPEN), c).otherwise(change(c))


def close_block(content: Column) -> Column:
    """An opened block without an end gets one behind its last line that is a field or blank."""
    fields = F.regexp_extract(content, rf"(?i)\A---[ \t]*\r?\n((?:(?:[ \t]*(?:(?:{KEYS})[ \t]*:[^\n]*)?)(?:\n|\z)(?!\z))*(?:[ \t]*(?:{KEYS})[ \t]*:[^\n]*(?:\n|\z)|[ \t]*\n)?)", 1)
    opening = F.regexp_extract(content, _OPEN, 0)
    rest = F.substr(content, F.length(opening) + F.length(fields) + 1)
    closed = F.concat(opening, F.regexp_replace(fields, r"\n\z", ""), F.lit("\n---\n"), rest)
    need = content.rlike(_OPEN) & ~content.rlike(r"(?s)\A---[ \t]*\r?\n.*?(?:\A|\n)---[ \t]*(?:\r?\n|\z)") & (F.trim(F.translate(fields, "\r\n", "")) != "")
    return F.when(need, closed).otherwise(content)


def block_of_inline_fields(content: Column) -> Column:
    """Fields in the first lines without a block, two or more and type first, become a block."""
    more = rf"\n(?![ \t]*#)(?:[ \t]*(?:{KEYS})[ \t]*:[^\n]*|[^\n]*\b(?:{KEYS})[ \t]*:[^\n]*\b(?:{KEYS})[ \t]*:[^\n]*)"
    head = F.regexp_extract(content, rf"(?i)\A[ \t]*type[ \t]*:[^\n]*(?:{more})*", 0)
    field = rf"(?i)\b({KEYS})[ \t]*:((?:(?!\b(?:{KEYS})[ \t]*:)[^\r\n])*)"
    names, values = (F.regexp_extract_all(head, F.lit(field), F.lit(k)) for k in (1, 2))
    lines = F.zip_with(names, values, lambda k, v: F.concat(F.lower(k), F.lit(": "), F.trim(v)))
    body = F.regexp_replace(F.substr(content, F.length(head) + 1), r"\A\s*\n(?:[ \t]*---[ \t]*(?:\r?\n|\z))?(?:[ \t]*\r?\n)*|\A\s+\z", "")
    made = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""))
    return F.when(~content.rlike(_OPEN) & (F.size(names) >= 2), made).otherwise(content)


def _plain_links(text: Column) -> Column:
    """Links as their labels, or as their targets."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]+\|[ \t]*([^\]]+?)[ \t]*\]\]", "$1"), r"\[\[[ \t]*([^\]|]+?)[ \t]*\]\]", "$1")


def _field_line(line: Column) -> Column:
    """One line of a block, with its links as the field can hold them."""
    part = lambda k, p: F.regexp_extract(line, p, k)
    lists = r"^(\s*[A-Za-z_][\w-]*\s*:\s*)(\[\[[^\]]+\]\](?:\s*,\s*\[\[[^\]]+\]\])+)\s*$"
    listed = F.transform(F.regexp_extract_all(part(2, lists), F.lit(r"\[\[[^\]]+\]\]"), F.lit(0)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    source = F.regexp_replace(_plain_links(line), r'^(\s*sources\s*:.*?"[^"]*")\]+(\s*)$', "$1]$2")
    scalar = r"^((?i:\s*(?:title|description|summary|origin)\s*:\s*))(.+?)\s*$"
    bare = _plain_links(F.regexp_replace(part(2, scalar), r'^"(.*)"$', "$1"))
    quoted = F.when(bare.rlike(r"""[:#,\[\]{}&*!|>'"%@`/\s]"""), F.concat(F.lit('"'), F.regexp_replace(bare, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(bare)
    nested = r"^(\s*(?:related|tags)\s*:\s*)(.+)$"
    raw = part(2, nested)
    linked = F.transform(F.regexp_extract_all(raw, F.lit(r"\[\[+([^\]]+)\]\]+"), F.lit(1)), lambda x: F.trim(x))
    others = F.transform(F.split(F.regexp_replace(raw, r"\[\[+[^\]]+\]\]+", ""), ","), lambda x: F.regexp_replace(x, r"^[\s\[\]]+|[\s\[\]]+$", ""))
    items = F.filter(F.array_distinct(F.concat(linked, others)), lambda x: x != "")
    items = F.transform(items, lambda x: F.when(x.rlike("[ ,|]"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return (
        F.when(line.rlike(r"(?i)^\s*sources\s*:") & line.contains("[["), source)
        .when(line.rlike(r'(?i)^\s*sources\s*:.*?"[^"]*"\]\]+\s*$'), source)
        .when(line.rlike(scalar) & part(2, scalar).contains("[["), F.concat(part(1, scalar), quoted))
        .when(line.rlike(lists), F.concat(part(1, lists), F.lit("["), F.array_join(listed, ", "), F.lit("]")))
        .when(line.rlike(nested) & raw.contains("[[[") & ~raw.rlike(r'^\[.*"\[\['), F.concat(part(1, nested), F.lit("["), F.array_join(items, ", "), F.lit("]")))
        .otherwise(line)
    )


def repair_fields(content: Column) -> Column:
    """Links in the fields of the leading block, in a form that can be read."""
    def mended(block: Column) -> Column:
        opening, payload, closing = (F.regexp_extract(block, _BLOCK, k) for k in (1, 2, 3))
        lines = F.array_join(F.transform(F.split(payload, "\n"), _field_line), "\n")
        return F.when(block == "", content).otherwise(F.concat(opening, lines, closing, F.substr(content, F.length(block) + 1)))

    return F.when(content.rlike(_OPEN), _let(F.regexp_extract(content, _BLOCK, 0), mended)).otherwise(content)


def whole_sources(sources: Column) -> Column:
    """Sources without fragments of names that were split at commas.

    A name within a longer one goes. If several are left and the longest is a file
    name of at least WHOLE of all joined, it alone stays; if all joined are a
    file name, that is the only one.
    """
    def of_left(own: Column, left: Column) -> Column:
        joined = F.array_join(own, ", ")
        size = F.array_max(F.transform(left, lambda s: F.length(s)))
        longest = F.get(F.filter(left, lambda s: F.length(s) == size), F.lit(0))
        return (
            F.when((F.size(own) < 2) | (F.size(left) < 2), left)
            .when(longest.rlike(ENDINGS) & (F.length(joined) * 1.0 <= F.length(longest) / WHOLE), F.array(longest))
            .when(joined.rlike(ENDINGS) & ~F.exists(F.slice(own, 1, F.size(own) - 1), lambda s: s.rlike(ENDINGS)), F.array(joined))
            .otherwise(left)
        )

    def of_own(own: Column) -> Column:
        left = F.filter(own, lambda s: ~F.exists(own, lambda t: (F.length(t) > F.length(s)) & F.contains(F.lower(t), F.lower(s))))
        return _let(left, lambda x: of_left(own, x))

    return _let(F.filter(F.transform(sources, lambda s: F.trim(s)), lambda s: s != ""), of_own)


def repair_sources(content: Column) -> Column:
    def mended(own: Column) -> Column:
        return _let(whole_sources(own), lambda whole: F.when((F.size(own) > 0) & (own != whole), R.with_array(content, "sources", whole)).otherwise(content))

    return F.when(content.rlike(_OPEN), _let(T.array_field(content, "sources"), mended)).otherwise(content)


#: Times that all rules are gone through: what one rule leaves may be what an earlier one mends.
PASSES = 3

#: The rules by name, in order.
RULES = [
    ("editor-marks", _all((r"\\([\[\]])", "$1"), (r"(?m)^\\---[ \t]*$", "---"), (r"(?im)^[ \t]*<br\s*/?>[ \t]*$", ""), (r"\n{4,}", "\n\n\n"))),
    ("joined-files", _all((r"(?s)\s*\r?\n---FILE:[ \t]*[^\r\n]+\r?\n.*\z", "\n"))),
    ("rules", _all((r"\A(?:\s*\*{3}[ \t]*\r?\n)+", ""), (r"(?m)^(?:[ \t]*-{10,}[ \t]*\r?\n)+", ""), (r"(?:\r?\n[ \t]*\*{3}\s*)+\z", "\n"), (r"(?m)^[ \t]*\*{3}[ \t]*$", ""))),
    ("yaml-fence", _all((r"(?i)\A---ya?ml(?:---)?[ \t]*(?=\r?\n|\z)", "---"))),
    ("glued-end", _all((r"(?im)^([ \t]*sources[ \t]*:[ \t]*\[[^\]\n]*\])[ \t]*\]+[ \t]*---[ \t]*$", "$1\n---"), (rf"(?im)^([ \t]*(?:{KEYS})[ \t]*:[^\n]*?[^\s-])[ \t]*-{{3,}}[ \t]*$", "$1\n---"))),
    ("glued-start", _unless_open(_all((r"\A---[ \t]+(?=\S)(?!---)", "---\n"), (rf"(?i)\A---(?=(?:{KEYS})[ \t]*:)", "---\n")))),
    ("missing-end", close_block),
    ("outer-fence", _all((r"(?s)\A[ \t]*```(?:yaml|md|markdown)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```\s*\z", "$1"))),
    ("key-prefix", _all((r"\A[ \t]*frontmatter[ \t]*:[ \t]*\r?\n(?=[ \t]*---[ \t]*\r?\n)", ""))),
    ("inline-fields", block_of_inline_fields),
    ("field-links", repair_fields),
    ("split-sources", repair_sources),
    ("second-end", _all((r"(?s)\A(---[ \t]*\r?\n.*?\r?\n---)[ \t]*\r?\n(?:[ \t]*---[ \t]*\r?\n)+", "$1\n"))),
]


def repaired(content: Column) -> Column:
    """content after all rules."""
    return repair_steps(content)["text"]


def repair_steps(content: Column) -> Column:
    """text, rules (the names of those that changed it, in order) and settled; each rule's result is worked out once.

    A pass that changes nothing is the last one, as all later ones would do the
    same; the text is then settled: mending it again changes nothing. Not
    settled is a text that all PASSES passes have changed, so nothing is known.
    """
    state = F.struct(content.alias("text"), F.array().cast("array<string>").alias("rules"), F.lit(False).alias("settled"))

    def gone_through(s: Column) -> Column:
        after = reduce(lambda x, rule: _bound(x, *rule), RULES, s)
        return _let(after, lambda x: F.struct(x["text"].alias("text"), x["rules"].alias("rules"), x["text"].eqNullSafe(s["text"]).alias("settled")))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(PASSES)), state, lambda s, _: F.when(s["settled"], s).otherwise(gone_through(s)),
        lambda s: F.struct(s["text"].alias("text"), F.array_distinct(s["rules"]).alias("rules"), s["settled"].alias("settled")),
    )


def _bound(state: Column, name: str, rule) -> Column:
    def after(s: Column) -> Column:
        def named(t: Column) -> Column:
            return F.struct(t.alias("text"), F.when(t.eqNullSafe(s["text"]), s["rules"]).otherwise(F.concat(s["rules"], F.array(F.lit(name)))).alias("rules"))

        return F.transform(F.array(rule(s["text"])), named)[0]

    return F.transform(F.array(state), after)[0]
