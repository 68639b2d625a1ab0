"""Filter interaction audit: what each of several filters does in every order.

A document's failures are bits of one number, its mask, so all orders of the
filters can be judged on the counts of masks (cells) and the texts are read
once. A recursive query starts with the empty prefix and every mask that occurs,
and extends each prefix by every filter that it has not used, carrying the bits
applied so far; each level of the recursion says what its step does to the
mask. Masks and prefixes are as many as the filters allow, whatever the data's
size (five filters: 32 masks, 325 prefixes), so that relation is broadcast to the
cells, whose counts give the figures.

Equal texts are found by SHA-256: the smallest doc_id of each text that occurs
more than once is a written table, to which every row is joined by hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize

#: Fixed value: the filters, in the order of their bits.
LETTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_SPACE = r"[\x20\x09-\x0D]+"


def text_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (the source, null as empty), key (SHA-256 of the text) and the bits of the filters A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("body")
    )
    read = read.withColumn("words", F.array_remove(F.split("body", _SPACE), "")).withColumn("n", F.size("words"))
    capitals = F.length("body") - F.length(F.regexp_replace("body", "[A-Z]+", ""))
    failed = [
        F.col("n") < FEWEST_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * F.col("n"),
        100 * capitals > CAPITAL_PERCENT * F.length("body"),
        F.col("body").rlike(r"[#$%&*|]"),
    ]
    bits = reduce(Column.__add__, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)])
    return read.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("key"), bits.alias("mask"))


def with_copies(masked: DataFrame, bit: int) -> DataFrame:
    """Rows of text_masks with the bit set where a smaller doc_id has the same text; a row without doc_id is no copy and has none."""
    firsts = masked.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    found = masked.join(materialize(firsts, "first-copies"), "key", "left")
    return found.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), bit).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: how many documents fail just the filters of the mask, and how many of them are labelled so.

    Labels of one doc_id that occur more than once count once, as good or toxic if any is.
    """
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("bad")
    )
    known = masked.where(F.col("doc_id").isNotNull()).join(own, "doc_id", "left").select("part", "mask", "good", "bad")
    none = masked.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("bad"))
    return known.unionByName(none).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("toxic")
    )


_WALK = """
WITH RECURSIVE walk(prefix, step, letter, mask, applied, kept, removed, redundant, alone) AS (
  SELECT '', 0, '', mask, 0, 0, 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT prefix || next.letter, step + 1, next.letter, mask, applied | next.bit,
    CAST(mask & (applied | next.bit) = 0 AS INT),
    CAST(mask & next.bit <> 0 AND mask & applied = 0 AS INT),
    CAST(mask & next.bit <> 0 AND mask & applied <> 0 AS INT),
    CAST(mask = next.bit AS INT)
  FROM walk LATERAL VIEW explode(filter({filters}, f -> applied & f.bit = 0)) AS next
)
SELECT * FROM walk WHERE step > 0
"""


def walk(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """prefix, step, letter, mask and what the prefix's last filter does to the mask, for every prefix of every order of the letters."""
    filters = "array(" + ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters)) + ")"
    return masks.sparkSession.sql(_WALK.replace("{filters}", filters), masks=masks)


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the step's counts, for every order of the letters, from cells()."""
    steps = walk(counted.select(F.col("mask").cast("int").alias("mask")).distinct(), letters)
    count = lambda flag, what="n": F.sum(F.col(flag) * F.col(what)).alias(f"{flag}_{what}")
    by_prefix = counted.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter").agg(
        count("kept"), count("removed"), count("redundant"), count("alone"), count("removed", "good"), count("removed", "toxic")
    )
    prefixes = steps.select("prefix").distinct()
    orders = prefixes.where(F.length("prefix") == len(letters)).select(F.col("prefix").alias("filter_order"))
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
    found = by_prefix.join(F.broadcast(orders.withColumn("prefix", F.expr("left(filter_order, at)")).drop("at")), "prefix")
    return found.select(
        "part", "filter_order", "step",
        F.col("kept_n").alias("kept"), F.col("removed_n").alias("removed"), F.col("redundant_n").alias("redundant"), F.col("alone_n").alias("unique_fails"),
        F.col("removed_good").alias("good_lost"), F.col("removed_toxic").alias("toxic_lost"),
        F.sum("removed_n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    The filters: A, under 50 words; B, under 65 percent distinct words; C, over
    5 percent capital letters; D, any of ``#$%&*|``; E, the text of a smaller
    doc_id. Every part has all 120 orders of five steps, zeros included. A null
    text is empty, and empty texts are equal; rows of one doc_id are no copies
    of each other; a null doc_id has no labels. An empty table gives no row.
    Other columns are not read.
    """
    masked = materialize(text_masks(docs), "masks")
    counted = materialize(cells(with_copies(masked, 1 << LETTERS.index("E")), labels), "cells")
    return interactions(counted)
