"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, each snapshot a turn or two
longer. Every turn of a conversation has the SHA-256 of its place, role and text,
and the running exclusive or of those stands for the prefix that ends there: a
window adds one turn to it at a time. A conversation whose last such mark is an inner
mark of another is a snapshot of that one; an anti-join on the marks drops it. Of
conversations with the same turns, the one with the smallest conv_id stays. Those
that are left are rendered. Marks are made distinct before they are joined, so a
first turn that very many conversations share is one row. Only DataFrame functions
are used; a task holds one conversation, the unit that is rendered, at a time.
Rows without conv_id belong to no conversation that could be known: each comes back
as one of its own, outside of marks and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize

#: The marks around a turn in the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _field(c: Column) -> Column:
    """A value with its length before it, so that neighbours cannot run together; null differs from empty."""
    return F.when(c.isNull(), F.lit("-;")).otherwise(F.concat(F.length(c).cast("string"), F.lit(";"), c))


def chains(turns: DataFrame) -> DataFrame:
    """conv_id and turns (ordered turn, role and text) of each conversation; rows without conv_id are left out.

    Turns are ordered by turn, then role, then text, nulls first. Rows that
    repeat a whole turn count once.
    """
    return _rows(turns).where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def prefixes(chained: DataFrame) -> DataFrame:
    """conv_id, k, n and mark of the prefix of k turns, for each turn of rows of chains()."""
    digest = lambda t, k: F.sha2(F.concat(k.cast("string"), F.lit(";"), _field(t["role"]), _field(t["text"])), 256)
    each = chained.select("conv_id", F.size("turns").alias("n"), F.posexplode(F.transform("turns", digest)).alias("at", "digest"))
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = lambda j: F.conv(F.substring("digest", 16 * j + 1, 15), 16, 10).cast("long")
    return each.select("conv_id", (F.col("at") + 1).alias("k"), "n", F.struct(*(F.bit_xor(word(j)).over(so_far).alias(f"w{j}") for j in range(4))).alias("mark"))


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that no other one continues or repeats: conv_id, turns, n_turns and n_copies (equal ones, itself included)."""
    chained = materialize(chains(turns), "chains")
    marks = materialize(prefixes(chained), "marks")
    inner = marks.where("k < n").select("mark").distinct()
    firsts = marks.where("k = n").groupBy("mark").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")).join(inner, "mark", "left_anti")
    found = chained.join(firsts.select("conv_id", "n_copies"), "conv_id").select("conv_id", "turns", F.size("turns").cast("long").alias("n_turns"), "n_copies")
    alone = _rows(turns).where("conv_id IS NULL").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("turns"))
    one = F.lit(1).cast("long")
    return found.unionByName(alone.select("conv_id", "turns", one.alias("n_turns"), one.alias("n_copies")))


def rendered(turns: Column) -> Column:
    """One text of a conversation's turns."""
    one = lambda t: F.concat(
        F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE), F.lit("\n")
    )
    return F.array_join(F.transform(turns, one), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and text of each maximal conversation, and of each row without conv_id; an empty table gives none.

    Very long texts are hashed where they stand; extra columns, whatever their names, are not read.
    """
    return maximal(turns).select("conv_id", "n_turns", "n_copies", rendered(F.col("turns")).alias("text"))
