"""Quality rules that begin with lines: lines that fail a rule go, and documents that lose too much of their text go with them.

A line with a word fails as

* boilerplate, if an earlier line of the text is equal, or if it is short and
  holds a phrase of site furniture;
* navigation, if separators are a quarter of its words or more, or if it is
  short and all its words are menu words;
* punctuation, if it is short and no sentence ends in it, or if more than a
  tenth of its characters are symbols.

What is left of a text is judged against the whole. Words in repeated windows
are counted by sorting one number a window: a hash of its words above, its place
below. Neighbours with equal hashes are then compared as words, so the count is
exact, and it takes n log n steps in a text of n words. A row is worked on where
it was read; nothing is shuffled. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document with fewer words, or with more of its words in repeated windows (percent), fails.
FEWEST_WORDS, REPEAT_PERCENT = 10, 20
#: Most percent of its word characters that a document may lose.
LOST_PERCENT = 30
#: Lines of as many characters or more are not short.
SHORT = 200
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Marks that stand between entries of a menu.
SEPARATORS = "|»›·•←→"
SENTENCE_END = r"""[.!?…。！？]["'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"""
MENU_WORDS = (
    "about archive archives back categories category comments contact copyright email faq forum help home in index links log login logout menu more next newer "
    "older our page policy posts previous print privacy register reply rss search share sign sitemap skip tags terms to top tweet up us"
).split()
PHRASES = [
    "accept all cookies", "accept cookies", "add to cart", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us on",
    "forgot your password", "javascript is disabled", "jump to navigation", "leave a comment", "lorem ipsum", "posted by", "powered by", "privacy policy", "read more",
    "share on facebook", "share on twitter", "share this", "sign up for our", "skip to content", "skip to main content", "subscribe to our", "terms of service",
    "terms of use", "this site uses cookies", "we use cookies", "your browser does not support",
]
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
MENU = rf"(?i)\A{_BREAK}*(?:(?:{'|'.join(MENU_WORDS)}){_BREAK}+)+\z"
FURNITURE = rf"(?i){'|'.join(PHRASES)}"


def _without(text: Column, pattern: str) -> Column:
    """Characters of text besides those of the pattern."""
    return F.length(F.regexp_replace(text, pattern, ""))


def line_passes(line: Column) -> Column:
    """Whether a line that no earlier one equals passes all other rules."""
    marks = _without(line, f"[^{SEPARATORS}]+")
    menu = (marks >= 2) & (4 * marks >= F.size(F.array_remove(F.split(line, f"{SPACE}+"), "")))
    odd = 10 * _without(line, f"[^{SYMBOLS}]+") > _without(line, f"{SPACE}+")
    short = (F.length(line) < SHORT) & (~line.rlike(SENTENCE_END) | F.concat(line, F.lit(" ")).rlike(MENU) | line.rlike(FURNITURE))
    return ~(short | menu | odd)


def _repeats() -> str:
    """SQL of the number of words in windows of five that occur twice or more, from an array of words.

    Each step is bound to its name by a lambda over an array of one, so it is worked out once a row wherever the optimizer puts the expression.
    """
    place = "cast(x & (shiftleft(1L, bits) - 1) AS int)"
    same = lambda k: f"shiftright(get(packed, j {k}), bits) = shiftright(x, bits)"
    steps = [
        ("ws", "words"), ("n", "size(ws)"), ("bits", "length(bin(n))"),
        ("packed", "CASE WHEN n < 6 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, n - 5), i -> shiftleft("
                   "xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]), bits) | cast(i AS bigint))) END"),
        ("met", f"filter(packed, (x, j) -> j > 0 AND {same('- 1')} OR j < size(packed) - 1 AND {same('+ 1')})"),
        ("grams", f"array_sort(transform(met, x -> named_struct('gram', array_join(slice(ws, {place} + 1, 5), ' '), 'at', {place})))"),
        ("places", "sort_array(transform(filter(grams, (x, j) -> j > 0 AND get(grams, j - 1).gram = x.gram OR j < size(grams) - 1 AND get(grams, j + 1).gram = x.gram), x -> x.at))"),
    ]
    out = "aggregate(transform(places, (x, j) -> least(5, x - coalesce(get(places, j - 1), -5))), 0L, (s, k) -> s + k)"
    for name, value in reversed(steps):
        out = f"transform(array({value}), {name} -> {out})[0]"
    return f"cast({out} AS bigint)"


def cleaned(docs: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs), the columns of judge(), and cleaned_text: the lines that pass all rules.

    Lines without a word are left out of cleaned_text.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"words": F.array_remove(F.split("body", f"{SPACE}+"), ""), "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    rows = rows.withColumns({"n": F.size("words"), "left": F.array_distinct("lines")})
    rows = rows.withColumn("n_repeat_words", F.expr(_repeats()))
    rows = rows.withColumn("kept_lines", F.filter("left", line_passes))
    rows = rows.withColumns({
        "n_words": F.col("n").cast("long"), "word_chars": _without(F.col("body"), f"{SPACE}+").cast("long"), "n_symbols": _without(F.col("body"), f"[^{SYMBOLS}]+").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size("left")).cast("long"), "n_lines": F.size("lines").cast("long"), "n_lines_kept": F.size("kept_lines").cast("long"),
        "cleaned_text": F.array_join("kept_lines", "\n"),
    })
    rows = rows.withColumn("kept_chars", _without(F.col("cleaned_text"), f"{SPACE}+").cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("kept_chars")) <= LOST_PERCENT * F.col("word_chars")))
    return rows.select("row", *_DIGEST, "cleaned_text")


_DIGEST = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept", "kept_chars"]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines (with a word), n_lines_kept and kept_chars.

    A null text has no words and fails, as does an empty one. Each row is judged
    alone, so repeated rows and a null doc_id come back as they are, and a very
    long text takes one task as long as its words take to sort. An empty table
    gives no row. Other columns are not read.
    """
    return cleaned(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), *_DIGEST)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the text of their passing lines, in the columns of docs."""
    done = cleaned(docs).where("kept")
    return done.select(*(F.col("cleaned_text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
