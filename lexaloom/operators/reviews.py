"""Review items and merged search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaloom.functions import text as T


def merge(reviews: DataFrame) -> DataFrame:
    """One pending review for each type and normalised title: the newest description, arrays united in order of time.

    reviews: id, type, title, description, affected (array), created_at, resolved. Resolved ones pass unchanged.
    """
    done = reviews.where("resolved")
    pending = reviews.where("NOT resolved").withColumn("key", T.review_title(F.col("title")))
    g = pending.groupBy("type", "key").agg(
        F.min_by("id", "created_at").alias("id"), F.max_by("title", "created_at").alias("title"), F.max_by("description", "created_at").alias("description"),
        F.sort_array(F.collect_list(F.struct("created_at", "id", "affected"))).alias("r"), F.max("created_at").alias("created_at"),
    )
    affected = F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["affected"], F.array().cast("array<string>")))))
    return g.select("id", "type", "title", "description", affected.alias("affected"), "created_at", F.lit(False).alias("resolved")).unionByName(done.select("id", "type", "title", "description", "affected", "created_at", "resolved"))


def from_violations(violations: DataFrame) -> DataFrame:
    """Review rows for the hard violations (path, level, violation) of pages."""
    hard = violations.where("level = 'hard'").groupBy("path").agg(F.array_sort(F.collect_set("violation")).alias("v"))
    return hard.select(F.sha2(F.concat_ws("|", "path", F.array_join("v", "|")), 256).alias("id"), F.lit("schema").alias("type"), F.concat(F.lit("Schema: "), "path").alias("title"), F.array_join("v", "; ").alias("description"), F.array("path").alias("affected"))


def best_hits(hits: DataFrame) -> DataFrame:
    """path and score of hits of several queries (path, score): the best score counts."""
    return hits.groupBy("path").agg(F.max("score").alias("score"))


def uncovered(entities: DataFrame, hits: DataFrame, top: int = 3) -> DataFrame:
    """Entities (name, query) that the titles and snippets of their query's first hits (query, rank, title, snippet) do not name."""
    seen = hits.where(F.col("rank") <= top).select("query", F.lower(F.concat_ws(" ", "title", "snippet")).alias("hay"))
    named = entities.join(seen, "query").where(F.contains("hay", F.lower("name"))).select("name", "query").distinct()
    return entities.join(named, ["name", "query"], "left_anti")
