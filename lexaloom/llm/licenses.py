"""License scans: an exact set-similarity join of text blocks with license templates.

A template is the words of a license notice. A block for templates of n words is
2n consecutive words of a text, and a block begins at every n-th word, so that a
notice lies whole in one, however its lines are wrapped or spaced, and a block is
as short as a text's lines are long. A block matches a template of its length if
it holds at least ``threshold`` of the template's
distinct words. Words are ordered by how many blocks hold them, rarest first,
over all documents. Two sets that share c words must meet within the first
n - c + 1 words of either (prefix filter), a block needs c template words at
all (length filter), and a meeting at some place can be completed to c shared
words only if enough words follow in both (positional filter). A pair is kept
at its first shared word only, so no pair comes twice and none is lost; the
pairs left are verified on whole sets. Everything is built of DataFrame
functions. Texts are split once: the counts, the base phrases and the blocks'
template words are written and read again. Templates are fixed, so what is
broadcast and collected (their words, with counts) does not grow with the data;
blocks are never shuffled, only matches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import materialize

#: Phrases of the base scan with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings of public license notices, with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.85
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text, in their own case, with single spaces between."""
    return F.trim(F.regexp_replace(text, _BREAKS, " "))


def word_array(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _starts(words: Column, phrase: list[str]) -> Column:
    """The places where the phrase's words stand one after another."""
    last = F.size(words) - len(phrase)

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def scanned(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """doc_id, key, n_words, at (an array of places for each base phrase) and blocks of each row; a narrow map.

    ``key`` is a hash of the text: with doc_id it ties rows together. A block is
    its size (half of its words) and those of its distinct words that the templates
    hold; those with too few for any template of their size are left out (length
    filter), and so are repeated ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.rlike("(?i)license").alias("known"), spaced(text).alias("plain"))
    # lower() is the faster one; of other letters it makes ASCII of the Kelvin sign only
    split = split.withColumn("words", word_array(F.lower(F.replace("plain", F.lit("\u212a"), F.lit("\ufffd")))))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counted = split.select(
        "doc_id", "key", F.when(F.col("known"), F.col("words")).otherwise(_none("string")).alias("flat"), F.size("words").alias("n"),
        F.transform("words", lambda w: F.when(w.isin(vocabulary), w)).alias("held"),
    )
    blocks = [_blocks(size, min(needed(t, threshold) for _, t in templates if len(t.split()) == size)) for size in sorted({len(t.split()) for _, t in templates})]
    at = F.array(*[_starts(F.col("flat"), p.split()) for p in PHRASES])
    return counted.select("doc_id", "key", F.col("n").cast("long").alias("n_words"), at.alias("at"), (F.concat(*blocks) if blocks else _none("struct<size:int,words:array<string>>")).alias("blocks"))


def _blocks(size: int, fewest: int) -> Column:
    """The distinct blocks of 2 * size words that hold fewest distinct words of templates or more, from columns held and n."""
    starts = F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)), F.lit(size))
    own = F.transform(starts, lambda i: F.array_compact(F.slice(F.col("held"), i, F.lit(2 * size))))
    own = F.transform(F.filter(own, lambda x: F.size(x) >= fewest), lambda x: F.array_sort(F.array_distinct(x)))
    own = F.array_distinct(F.filter(own, lambda x: F.size(x) >= fewest))
    return F.transform(own, lambda x: F.struct(F.lit(size).alias("size"), x.alias("words")))


def needed(template: str, threshold: float) -> int:
    """How many of a template's distinct words a match has at least."""
    return max(1, -int(-threshold * len(set(template.split())) // 1))


def matches(found: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, label and containment of each block and template of its size that meet the threshold; found: rows of scanned()."""
    spark = found.sparkSession
    sets = [(label, len(text.split()), list(dict.fromkeys(text.split())), needed(text, threshold)) for label, text in templates]
    vocabulary = sorted({w for _, _, ws, _ in sets for w in ws})
    own = found.select("doc_id", "key", F.explode("blocks").alias("block")).select("doc_id", "key", "block.size", "block.words")
    counted = own.select(F.explode("words").alias("word")).groupBy("word").count()
    often = {r["word"]: r["count"] for r in counted.collect()}  # a row for each template word at most
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for t, (label, size, ws, need) in enumerate(sets):
        ws = sorted(ws, key=rank.__getitem__)
        rows += [(ws[i], size, i, t, label, ws, need) for i in range(len(ws) - need + 1)]
    prefixes = spark.createDataFrame(rows, "word string, size int, i int, template int, label string, shared_of array<string>, need int")
    wanted = _strings(sorted({r[0] for r in rows}))
    own = own.where(F.arrays_overlap("words", wanted)).select("doc_id", "key", "size", F.array_intersect(_strings(order), F.col("words")).alias("known"))
    at = own.select("doc_id", "key", "size", "known", F.posexplode("known").alias("j", "word"))
    pairs = at.join(F.broadcast(prefixes), ["word", "size"]).where(
        (F.size("known") >= F.col("need"))
        & (F.col("j") <= F.size("known") - F.col("need"))
        & (F.least(F.size("shared_of") - F.col("i"), F.size("known") - F.col("j")) >= F.col("need"))
    )
    pairs = pairs.select("doc_id", "key", "word", "label", "need", F.array_intersect("shared_of", "known").alias("shared"), F.size("shared_of").alias("n"))
    return pairs.where((F.size("shared") >= F.col("need")) & (F.get("shared", F.lit(0)) == F.col("word"))).select(
        "doc_id", "key", "label", (F.size("shared") / F.col("n")).alias("containment")
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    labels joins the base labels and those of matching templates; score is 1
    with a base phrase, else the largest containment found, else 0. A null text
    counts as empty; repeated rows are reported each; an empty table gives an
    empty result. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    found = materialize(scanned(docs, templates, threshold), "scanned")
    more = matches(found, templates, threshold).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment")
    )
    both = found.drop("blocks").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    every = F.flatten("at")
    labels = F.array(*[F.when(F.size(F.get("at", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])
    both = both.withColumn("every", every).withColumn("base", F.array_compact(labels))
    n_base = F.size("every").cast("long")
    return both.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", _none("string")))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
