"""Page deduplication by key: clusters, candidate sets, merging and its cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaloom.functions import text as T


def clusters(names: DataFrame) -> DataFrame:
    """key, n and names (sorted, comma-joined) of names that differ in marks and case only."""
    keyed = names.select(T.dedup_key(F.col("name")).alias("key"), "name").where("key <> ''").distinct()
    found = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    return found.where("n > 1").select("key", "n", F.array_join("names", ",").alias("names"))


def candidate_sets(found: DataFrame, near: DataFrame, seeds: DataFrame) -> DataFrame:
    """members of each candidate set, once: clusters that a seed is in, and each seed with its neighbours.

    found: names (array); near: seed, other; seeds: name.
    """
    member = found.select("names", F.explode("names").alias("name")).join(seeds.select("name"), "name", "left_semi").select(F.array_sort("names").alias("members"))
    own = near.join(seeds.select(F.col("name").alias("seed")), "seed", "left_semi")
    around = own.groupBy("seed").agg(F.collect_set("other").alias("others")).select(F.array_sort(F.array_union("others", F.array("seed"))).alias("members"))
    return member.unionByName(around).where(F.size("members") > 1).dropDuplicates(["members"])


def union_ignoring_case(existing: Column, incoming: Column) -> Column:
    """Items of both arrays, existing first; of items that are equal but for case the first stays."""
    every = F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(incoming, F.array().cast("array<string>")))
    lows = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)


def merge_groups(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """slug, canonical and the united tags, related and sources of each group's canonical page.

    pages: slug, tags, related, sources; groups: slug, canonical. Arrays are
    united in the order canonical first, then by slug.
    """
    both = groups.join(pages, "slug")
    order = F.struct((F.col("slug") != F.col("canonical")).alias("o"), "slug", "tags", "related", "sources")
    each = both.groupBy("canonical").agg(F.sort_array(F.collect_list(order)).alias("rows"))
    none = F.array().cast("array<string>")
    united = lambda name: F.aggregate("rows", none, lambda s, r: union_ignoring_case(s, r[name])).alias(name)
    return each.select(F.col("canonical").alias("slug"), united("tags"), united("related"), united("sources"))


def redirect(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """id and target of links after a merge; redirects: old, new."""
    joined = links.join(redirects.select(F.col("old").alias("target"), "new"), "target", "left")
    return joined.select("id", F.coalesce("new", "target").alias("target")).where("id <> target").distinct()


def delete_source(pages: DataFrame, source: str) -> DataFrame:
    """id, fate (delete, rewrite or keep) and the sources left when a source goes; pages: id, sources."""
    left = F.filter("sources", lambda s: F.lower(s) != source.lower())
    hit = F.size(left) < F.size("sources")
    fate = F.when(hit & (F.size(left) == 0), "delete").when(hit, "rewrite").otherwise("keep")
    return pages.select("id", fate.alias("fate"), left.alias("sources"))


def upsert(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """table with the rows of every key in incoming replaced by incoming's; an empty incoming changes nothing."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)
