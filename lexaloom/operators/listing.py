"""Index and log upkeep, manifests and page listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.functions import markup as M
from lexaloom.functions import rewriting as R
from lexaloom.functions import text as T
from lexaloom.operators.quality import STRUCTURAL


def listing(pages: DataFrame) -> DataFrame:
    """path, target, title and section of every page that is not structural; pages: path, content."""
    p = F.col("path")
    return pages.where(~T.file_stem(p).isin(STRUCTURAL)).select(
        "path", T.page_key(p).alias("target"), T.page_title(F.col("content"), p).alias("title"), F.element_at(F.split(p, "/"), 2).alias("section")
    )


def link_keys(index: DataFrame) -> DataFrame:
    """Distinct keys of the links of index pages (content)."""
    return index.select(F.explode(T.link_targets(F.col("content"))).alias("t")).select(M.ref_key(F.col("t")).alias("key")).distinct()


def unlisted(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Pages of listing() that no link of the index leads to."""
    return listing(pages).withColumn("key", M.ref_key(F.col("target"))).join(link_keys(index), "key", "left_anti").drop("key")


def is_stale(pages: DataFrame, index: DataFrame, least_pages: int = 50) -> DataFrame:
    """One row: n_pages, n_listed and stale (more than least_pages, under half of them listed)."""
    rows = listing(pages).withColumn("key", M.ref_key(F.col("target")))
    j = rows.join(link_keys(index).withColumn("there", F.lit(1)), "key", "left")
    n, listed = F.count(F.lit(1)), F.count("there")
    return j.agg(n.alias("n_pages"), listed.alias("n_listed"), ((n > least_pages) & (listed * 2 < n)).alias("stale"))


def index_lines(rows: DataFrame) -> DataFrame:
    """section, position (from 1, by title) and line of each entry of a fresh index from listing(); a section is never one row."""
    line = F.concat(F.lit("- [["), "target", F.lit("|"), "title", F.lit("]]"))
    at = F.row_number().over(Window.partitionBy("section").orderBy("title", "target"))
    return rows.select("section", at.cast("long").alias("position"), line.alias("line"))


def repeated_lines(logs: DataFrame) -> DataFrame:
    """line and n of lines that logs (content) hold more than once, blanks left out."""
    lines = logs.select(F.explode(F.split("content", "\n")).alias("l")).select(F.trim("l").alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def type_collisions(pages: DataFrame) -> DataFrame:
    """Slugs that are both a concept's and an entity's."""
    p = pages.select(F.element_at(F.split("path", "/"), 2).alias("folder"), T.file_stem(F.col("path")).alias("slug"))
    return p.where("folder = 'concepts'").select("slug").intersect(p.where("folder = 'entities'").select("slug"))


def created_histogram(pages: DataFrame) -> DataFrame:
    """created and n of pages (content), for the created field."""
    return pages.groupBy(T.scalar_field(F.col("content"), "created").alias("created")).agg(F.count(F.lit(1)).alias("n")).where("created IS NOT NULL")


def coverage(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """name and there of a manifest's rows (name), the first of each key; pages: path."""
    first = manifest.withColumn("key", T.dedup_key(F.col("name"))).groupBy("key").agg(F.min("name").alias("name"))
    own = pages.select(T.dedup_key(T.file_stem(F.col("path"))).alias("key"), F.lit(True).alias("there")).distinct()
    return first.join(own, "key", "left").select("name", F.coalesce("there", F.lit(False)).alias("there"))


def dangling(pages: DataFrame) -> DataFrame:
    """Distinct related items of pages (path, content) that lead to no page."""
    wanted = pages.select(F.explode(T.array_field(F.col("content"), "related")).alias("title")).select("title", M.ref_key(F.col("title")).alias("key")).distinct()
    return wanted.join(pages.select(M.ref_key(T.file_stem(F.col("path"))).alias("key")).distinct(), "key", "left_anti").select("title")


def delete_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """pages (path, content) after pages (slug, title) have gone: themselves dropped, links to them plain, list lines and related items removed.

    A page meets the keys of its own links and related items only, in an equi-join; nothing of what goes is collected.
    """
    keys = gone.select(F.explode(F.array(M.ref_key(F.col("slug")), M.ref_key(F.col("title")))).alias("key")).where("key <> ''").distinct()
    own = pages.select("path", "content", M.ref_key(T.file_stem(F.col("path"))).alias("key"))
    left = own.join(keys, "key", "left_anti").drop("key")
    refs = left.select("path", F.explode(F.array_distinct(F.transform(R.references(F.col("content")), M.ref_key))).alias("key"))
    hit = refs.join(keys, "key", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    text = left.join(hit, "path", "left").withColumn("text", M.without_links(M.without_listing(F.col("content"), F.col("keys")), F.col("keys")))
    text = text.withColumn("items", T.array_field(F.col("text"), "related"))
    text = text.withColumn("kept", F.filter("items", lambda x: ~F.array_contains(F.col("keys"), M.ref_key(M.link_slug(x)))))
    related = F.when(F.size("kept") < F.size("items"), R.with_array(F.col("text"), "related", F.col("kept"))).otherwise(F.col("text"))
    return text.select("path", F.when(F.col("keys").isNull(), F.col("content")).otherwise(related).alias("content"))
