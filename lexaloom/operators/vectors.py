"""Chunk vectors as versioned tables: upsert, delete, count and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Not empty, and every element a finite number."""
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def embedding_input(title: Column, heading: Column, text: Column) -> Column:
    """What is embedded of a chunk: title, heading path and text, blank ones left out."""
    return F.array_join(F.filter(F.array(title, heading, text), lambda x: F.trim(x) != ""), "\n\n")


def upsert_chunks(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """store with all chunks of every page in incoming replaced; no incoming rows change nothing.

    Both: chunk_id, page_id, chunk_index, vector. Rows of vectors that are not finite are left out.
    """
    good = incoming.where(is_finite(F.col("vector")))
    return store.join(good.select("page_id").distinct(), "page_id", "left_anti").select(store.columns).unionByName(good.select(store.columns))


def delete_pages(store: DataFrame, pages: DataFrame) -> DataFrame:
    return store.join(pages.select("page_id").distinct(), "page_id", "left_anti").select(store.columns)


def sizes(store: DataFrame) -> DataFrame:
    """n_chunks, n_pages and n_sizes (more than one: vectors of different models are mixed) of a store."""
    return store.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("page_id").alias("n_pages"), F.count_distinct(F.size("vector")).alias("n_sizes"))
