"""Evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(score: Column) -> Column:
    """A judge's score within 1 to 5."""
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), score.cast("double")))


def choice_score(answer: Column, correct: Column) -> Column:
    """5 for the right letter, else 1."""
    return F.when(F.upper(F.trim(answer)) == F.upper(F.trim(correct)), 5.0).otherwise(1.0)


def summary(rows: DataFrame) -> DataFrame:
    """skill (null: all), n, wiki, baseline and delta means of rows (skill, wiki, baseline, failed), failed ones left out."""
    w, b = F.avg(judged(F.col("wiki"))), F.avg(judged(F.col("baseline")))
    return rows.where("NOT failed").rollup("skill").agg(F.count(F.lit(1)).alias("n"), F.round(w, 6).alias("wiki"), F.round(b, 6).alias("baseline"), F.round(w - b, 6).alias("delta"))


def document_score(title: Column, content: Column, tokens: list[str]) -> Column:
    """Places in the title, five for each, and in the content, ten at most, of each token."""
    from lexaloom.functions.text import occurrences

    out = F.lit(0)
    for t in tokens:
        out = out + 5 * occurrences(F.lower(title), t) + F.least(F.lit(10), occurrences(F.lower(content), t))
    return out
