"""Joins on parts of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(n: int) -> Column:
    """Hashes of all runs of n pieces."""
    return F.transform(F.sequence(F.lit(1), F.size("own") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("own"), i, F.lit(n)), " ")))


def _substrings(size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.substring("text", i, F.lit(size)))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """id and key of texts (id, text) that contain a part (key, part) as a substring.

    What stands between spaces inside a part stands between spaces in the text
    too. So the second to fourth pieces of a part (fewer if it is shorter) are
    an anchor: texts meet parts in an equi-join on hashes of their runs of
    pieces, and only those that meet are compared. Parts of one or two pieces
    have no anchor; they are looked up among the text's substrings of their
    lengths, a pass that runs only if there are any.
    """
    pieces = F.split("part", " ", -1)
    known = parts.where("part <> ''").withColumn("n", F.least(F.size(pieces) - 2, F.lit(3)))
    anchored = known.where("n > 0").select("key", "part", "n", F.xxhash64(F.array_join(F.slice(pieces, F.lit(2), F.col("n")), " ")).alias("h"))
    found = []
    for (n,) in anchored.select("n").distinct().collect():  # three lengths at most
        own = F.split("text", " ", -1)
        at = texts.select("id", own.alias("own")).where(F.size("own") >= n)
        runs = at.select("id", F.explode(F.array_distinct(_runs(n))).alias("h"))
        found.append(runs.join(anchored.where(F.col("n") == n), "h").select("id", "key", "part"))
    for (size,) in known.where("n <= 0").select(F.length("part")).distinct().collect():
        own = texts.where(F.length("text") >= size).select("id", F.explode(F.array_distinct(_substrings(size))).alias("part"))
        found.append(own.join(known.where("n <= 0").select("key", "part"), "part").select("id", "key", "part"))
    if not found:
        return texts.select("id", F.lit(None).cast(parts.schema["key"].dataType).alias("key")).limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct().join(texts, "id").where(F.contains("text", F.col("part"))).select("id", "key").distinct()
