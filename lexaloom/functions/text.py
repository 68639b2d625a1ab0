"""Scalar expressions on page text, references and names, built of Spark functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that a query's tokens leave out.
STOP_EN = (
    "the is a an what how are was were do does did be been being have has had it its in on at to for of with by this that these those"
).split()
STOP_CN = "的 是 了 什么 在 有 和 与 对 从".split()
# Separators besides white space and ASCII punctuation.
SEPARATORS = "，。！？、；：“”‘’（）·～…"

_SPLIT = re.compile(r"[\s!-/:-@\[-`{-~" + SEPARATORS + "]+")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """text with compatibility forms normalised. Spark has no function for it; texts in ASCII are passed to Python as null."""
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


def query_tokens(query: str) -> list[str]:
    """Sorted distinct tokens of a query; a CJK token longer than two characters adds its pairs and single characters."""
    stop = {*STOP_EN, *STOP_CN}
    out: set[str] = set()
    for t in _SPLIT.split(query.lower()):
        if len(t) > 1 and t not in stop:
            out.add(t)
            if len(t) > 2 and any("㐀" <= c <= "鿿" for c in t):
                out.update(t[i : i + 2] for i in range(len(t) - 1))
                out.update(c for c in t if c not in stop)
    return sorted(out)


def query_phrase(query: str) -> str:
    """The lower-cased query without punctuation at its ends."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", query.lower())


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs in text without overlap."""
    if not part:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def contains_count(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens are substrings of text."""
    out = F.lit(0)
    for t in tokens:
        out = out + F.contains(text, F.lit(t)).cast("int")
    return out


def body_of(content: Column) -> Column:
    """Content without its leading front matter block."""
    return F.regexp_replace(content, r"^---\r?\n(?s:.*?)\r?\n---\r?\n?", "")


def front_matter(content: Column) -> Column:
    """The text of the leading front matter block, or null."""
    found = F.regexp_extract(content, r"^---\r?\n(?s:(.*?))\r?\n---(?:\r?\n|$)", 1)
    return F.when(found != "", found)


def scalar_field(content: Column, name: str) -> Column:
    """A scalar front matter field without quotes, or null."""
    value = F.regexp_extract(front_matter(content), rf"(?m)^{re.escape(name)}:[ \t]*(.+?)[ \t]*$", 1)
    value = F.regexp_replace(value, "^[\"']|[\"']$", "")
    return F.when(value != "", value)


def array_field(content: Column, name: str) -> Column:
    """A list field of the front matter: a block list, an inline list, or a scalar as a list of one."""
    block = F.regexp_extract(front_matter(content), rf"(?m)^{re.escape(name)}:[ \t]*\r?\n((?:[ \t]*-[ \t]*.+(?:\r?\n|$))+)", 1)
    listed = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.+?)[ \t]*$"), F.lit(1))
    line = F.coalesce(F.regexp_extract(front_matter(content), rf"(?m)^{re.escape(name)}:[ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))
    inner = F.regexp_extract(line, r"^\[(.*)\]$", 1)
    inline = F.regexp_extract_all(inner, F.lit("\\s*(\"[^\"]*\"|'[^']*'|[^,]+)"), F.lit(1))
    values = F.when(F.size(listed) > 0, listed).when(line.startswith("["), inline).when(line != "", F.array(line)).otherwise(F.array().cast("array<string>"))
    clean = F.transform(values, lambda v: F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""))
    return F.filter(clean, lambda v: v != "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def page_key(path: Column) -> Column:
    """A page's identifier: its path within the wiki folder, without extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^wiki/", ""), r"\.md$", "")


def page_title(content: Column, path: Column) -> Column:
    """The title field, else the first level-one heading, else the file name with spaces for hyphens."""
    heading = F.regexp_extract(body_of(content), r"(?m)^# +(.+?)\s*$", 1)
    return F.coalesce(scalar_field(content, "title"), F.when(heading != "", heading), F.replace(file_stem(path), F.lit("-"), F.lit(" ")))


def page_type(content: Column) -> Column:
    return F.coalesce(F.lower(scalar_field(content, "type")), F.lit("other"))


def link_targets(content: Column) -> Column:
    """Targets of wiki links, trimmed, in order."""
    found = F.regexp_extract_all(content, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def image_urls(content: Column) -> Column:
    """Distinct image addresses in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"!\[[^\]]*\]\(([^\s)]+)\)"), F.lit(1)))


def hyphenated(text: Column) -> Column:
    """Lower-cased, with hyphens for runs of white space."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")


def page_id(name: Column, most: int = 80) -> Column:
    """A slug: camel case is split, other than letters and digits become single hyphens, and at most 80 characters stay.

    A longer slug is cut at its last hyphen within the limit. Pass nfkc(name) where compatibility forms may occur.
    """
    split = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1-$2")
    slug = F.regexp_replace(F.regexp_replace(F.lower(split), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    head = F.substring(slug, 1, most)
    cut = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(slug) > most, F.when(cut != "", cut).otherwise(head)).otherwise(slug)


def dedup_key(name: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""))


def query_slug(text: Column, most: int = 50) -> Column:
    """A file name for a query: hyphens for white space, other marks dropped, `query` if nothing stays."""
    slug = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "-"), r"[^\p{L}\p{N}-]", "")
    slug = F.regexp_replace(F.regexp_replace(F.substring(F.lower(slug), 1, most), "-+", "-"), "^-|-$", "")
    return F.when(slug == "", "query").otherwise(slug)


# What may stand before a colon at the start of a review's title.
TITLE_PREFIXES = r"missing[\s-]?page|duplicate[\s-]?page|possible[\s-]?duplicate|缺失页面|缺少页面|重复页面|疑似重复"


def review_title(title: Column) -> Column:
    """A review's title without its prefix, with single spaces, lower-cased."""
    plain = F.regexp_replace(title, rf"(?i)^(?:{TITLE_PREFIXES})[:：]\s*", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def is_kebab(slug: Column) -> Column:
    return slug.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def snippet(text: Column, anchors: list[str], around: int = 80) -> Column:
    """Text around the first anchor that occurs, on one line, with dots where it goes on."""
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.instr(low, a), F.lit(0)) for a in anchors], F.lit(1))
    size = F.coalesce(*[F.when(F.instr(low, a) > 0, F.lit(len(a))) for a in anchors], F.lit(0))
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + size + around - 1, F.length(text))
    middle = F.replace(F.substring(text, first, last - first + 1), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(first > 1, "...").otherwise(""), middle, F.when(last < F.length(text), "...").otherwise(""))


# Scripts by Unicode range.
SCRIPTS = {
    "Chinese": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}", "Japanese": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}",
    "Korean": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}", "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "Hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}", "Thai": r"\x{0E00}-\x{0E7F}", "Hindi": r"\x{0900}-\x{097F}", "Russian": r"\x{0400}-\x{052F}",
    "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}", "Bengali": r"\x{0980}-\x{09FF}", "Tamil": r"\x{0B80}-\x{0BFF}", "Telugu": r"\x{0C00}-\x{0C7F}",
    "Kannada": r"\x{0C80}-\x{0CFF}", "Malayalam": r"\x{0D00}-\x{0D7F}", "Gujarati": r"\x{0A80}-\x{0AFF}", "Punjabi": r"\x{0A00}-\x{0A7F}",
    "Burmese": r"\x{1000}-\x{109F}", "Khmer": r"\x{1780}-\x{17FF}", "Lao": r"\x{0E80}-\x{0EFF}", "Georgian": r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}",
    "Armenian": r"\x{0530}-\x{058F}", "Amharic": r"\x{1200}-\x{137F}", "Tibetan": r"\x{0F00}-\x{0FFF}", "Sinhala": r"\x{0D80}-\x{0DFF}",
}
# Marks of languages in Latin script, in order of precedence: letters and words, both of which must occur if both are given.
LATIN = [
    ("Vietnamese", "[ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỳỷỹỵ]", ""),
    ("Turkish", "[ğış]", "bir|ve|için|ile|bu|da|de|değil|ama"),
    ("Polish", "[ąćęłńóśźż]", ""),
    ("Czech", "[ěšžřďťňů]", ""),
    ("Romanian", "[ăâîșț]", "și|este|sau|care|pentru"),
    ("Hungarian", "[őű]", ""),
    ("German", "", "und|der|die|das|ist"),
    ("French", "", "le|la|les|est|une|des"),
    ("Portuguese", "[ãõç]", "o|a|os|as|de|do|da|é|em|um|uma|não|que"),
    ("Spanish", "", "el|los|las|del|por"),
    ("Spanish", "[ñ¿¡]", ""),
    ("Italian", "", "il|della|gli|che|è"),
    ("Dutch", "", "het|een|van|dat"),
    ("Swedish", "[åäö]", "och|att|det|en|ett|är|för|med"),
    ("Norwegian", "[åæø]", "og|er|det|en|et|for|med|på"),
    ("Danish", "[åæø]", "og|er|det|en|et|til|med|af"),
    ("Finnish", "[äö]", "ja|on|ei|se|että|tai|kun|niin"),
    ("Indonesian", "", "yang|dari|untuk|dengan|adalah"),
    ("Swahili", "", "na|ya|wa|ni|kwa|katika|hii|hiyo"),
]
# Letters (with their weight) and words that tell Persian from Arabic.
PERSIAN = ([("[پچژگ]", 3), ("[کی]", 1)], "این است که برای های را در به از می یک".split())
ARABIC = ([("[كيةىإأؤئ]", 1)], "ال في من على هذا هذه إلى التي الذي كان".split())
#: A word's edge, where a word is letters A to Z, digits and underscores; other letters are none.
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _arabic_score(text: Column, letters: list[tuple[str, int]], words: list[str]) -> Column:
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    out = F.lit(0)
    for pattern, weight in letters:
        out = out + weight * F.regexp_count(text, F.lit(pattern))
    for w in words:
        out = out + 2 * F.contains(spaced, F.lit(f" {w} ")).cast("int")
    return out


def _latin(low: Column, other: Column, words: Column) -> Column:
    """The first language whose marks low (lower-cased) has; other is low without ASCII, where all letters that mark a language are, and words are its ASCII words that mark one."""
    out = F.when(F.lit(False), F.lit(""))
    for name, letters, marks in LATIN:
        plain = [w for w in marks.split("|") if w.isascii() and w]
        accented = [w for w in marks.split("|") if not w.isascii()]
        found = F.arrays_overlap(words, F.array(*map(F.lit, plain))) if plain else F.lit(not marks)
        for w in accented:
            found = found | (F.contains(low, F.lit(w)) & low.rlike(f"{_EDGE}{w}{_EDGE}"))
        out = out.when(other.rlike(letters) & found if letters else found, F.lit(name))
    return out.otherwise(F.lit("English"))


def detect_language(text: Column) -> Column:
    """A language name: by script where two or more letters of one stand out, else by Latin letters and function words, else English.

    Scripts are counted on what is left of a text without ASCII and Latin
    letters, mostly nothing; of scripts as frequent, the one that comes first
    counts. A text's words are listed once for all languages.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def by_script(s: Column) -> Column:
        rest = s["rest"]
        n = {name: F.regexp_count(rest, F.lit(f"[{p}]")) for name, p in SCRIPTS.items()}
        first = {name: F.regexp_instr(rest, F.lit(f"[{p}]")) for name, p in SCRIPTS.items()}
        most = F.array_max(F.array(*[F.struct(n[k].alias("n"), (-first[k]).alias("at"), F.lit(k).alias("name")) for k in SCRIPTS]))
        both = rest.rlike(f"[{SCRIPTS['Japanese']}]") & rest.rlike(f"[{SCRIPTS['Chinese']}]")
        persian = _arabic_score(text, *PERSIAN)
        named = lambda m: F.when((m["name"] == "Arabic") & (persian >= 3) & (persian > _arabic_score(text, *ARABIC)), F.lit("Persian")).otherwise(m["name"])
        return F.when(rest == "", F.lit(None).cast("string")).when(both, F.lit("Japanese")).otherwise(once(most, lambda m: F.when(m["n"] >= 2, named(m))))

    def by_words(s: Column) -> Column:
        marks = sorted({w for _, _, m in LATIN for w in m.split("|") if w.isascii() and w})
        words = F.array_intersect(F.split(s["low"], "[^a-z0-9_]+"), F.array(*map(F.lit, marks)))
        other = F.regexp_replace(s["low"], r"[\x00-\x7F]+", "")
        return once(F.struct(s["low"].alias("low"), other.alias("other"), words.alias("words")), lambda x: _latin(x["low"], x["other"], x["words"]))

    parts = F.struct(F.regexp_replace(text, r"[\x00-\x{036F}]+", "").alias("rest"), F.lower(text).alias("low"))
    return F.when(text.isNotNull(), once(parts, lambda s: F.coalesce(by_script(s), by_words(s)))).otherwise(F.lit("English"))

