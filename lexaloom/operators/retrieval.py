"""Hybrid retrieval: keyword scores, nearest vectors, page blending, rank fusion and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.functions import text as T
from lexaloom.session import cut_statistics


def keyword_scores(pages: DataFrame, query: str) -> DataFrame:
    """path, title, score, title_match of the pages that the query hits.

    pages: path, title, file_name, content. A narrow map: one scan, no shuffle.
    """
    tokens, phrase = T.query_tokens(query) or [query.strip().lower()], T.query_phrase(query)
    title = F.lower(F.concat_ws(" ", "title", "file_name"))
    low = F.lower("content")
    stem = F.regexp_replace(F.lower("file_name"), r"\.md$", "")
    exact = F.lit(bool(phrase)) & (stem == phrase)
    in_title = F.lit(bool(phrase)) & F.contains(title, F.lit(phrase))
    found = pages.select(
        "path", "title", exact.alias("exact"), in_title.alias("in_title"), F.least(F.lit(10), T.occurrences(low, phrase)).alias("occ"),
        T.contains_count(title, tokens).alias("in_titles"), T.contains_count(low, tokens).alias("in_content"),
    )
    score = 200 * F.col("exact").cast("int") + 50 * F.col("in_title").cast("int") + 20 * F.col("occ") + 5 * F.col("in_titles") + F.col("in_content")
    return found.select(
        "path", "title", score.cast("double").alias("score"), ((F.col("in_titles") > 0) | F.col("in_title")).alias("title_match")
    ).where("score > 0")


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance in double precision."""
    other = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k chunks (vec_id, page, embedding) nearest to a vector, with distance and score 1 / (1 + distance).

    Vectors of another size are left out. Each task keeps its own k best; only those are merged.
    """
    d = F.round(squared_distance(F.col("embedding"), query), 9)
    scored = chunks.where(F.size("embedding") == len(query)).select("vec_id", "page", d.alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(k).withColumn("score", 1 / (1 + F.col("distance")))


def blend_pages(hits: DataFrame, limit: int) -> DataFrame:
    """page, score and n_chunks: the best chunk's score plus 0.3 of the others', up to 1."""
    best, total = F.max("score"), F.sum("score")
    blended = best + F.least(0.3 * (total - best), F.greatest(F.lit(0.0), 1 - best))
    pages = hits.groupBy("page").agg(blended.alias("score"), F.count(F.lit(1)).alias("n_chunks"))
    return pages.orderBy(F.desc("score"), "page").limit(limit)


def vector_pages(chunks: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """Pages by blended chunk scores, from max(3k, 30) chunks with k = max(limit, 10)."""
    k = max(limit, 10)
    return blend_pages(nearest(chunks, query, max(3 * k, 30)), k)


def ranked(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """key and its 1-based rank of the best depth rows by (score descending, key)."""
    top = rows.select(key, "score").orderBy(F.desc("score"), key).limit(depth)
    return top.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def ranks_of(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """key and rank, among all rows by (score descending, key), of the few rows whose key is wanted: better rows are counted, not sorted."""
    own = rows.where(F.col(key).isin(wanted)).select(key, "score").collect() if wanted else []
    better = [F.count_if((F.col("score") > r["score"]) | ((F.col("score") == r["score"]) & (F.col(key) < r[key]))) for r in own]
    counted = rows.agg(*better).first() if better else []
    return rows.sparkSession.createDataFrame([(r[key], n + 1) for r, n in zip(own, counted, strict=True)], f"`{key}` string, rank long")


def fuse(keyword: DataFrame, vector: DataFrame, key: str = "path", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: key, keyword_rank, vector_rank, score."""
    a = keyword.select(key, F.col("rank").alias("keyword_rank"))
    b = vector.select(key, F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("score", part("keyword_rank") + part("vector_rank"))


def fused_pages(words: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """path, score and mode of the top_k pages by fused rank of keyword hits (path, score) and vector hits (path, score; few).

    A page of the result is among the best top_k of one list at least. So the
    keyword ranks that count are those of the first top_k and those of the
    vector hits, wherever they stand.
    """
    words = cut_statistics(words.select("path", "score"))
    near = [r["path"] for r in hits.select("path").collect()]
    first = ranked(words, "path", top_k)
    keyword = first.unionByName(ranks_of(words, "path", near)).distinct()
    fused = fuse(keyword, ranked(hits, "path", len(near) or 1))
    mode = F.when(F.col("keyword_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "keyword").otherwise("hybrid")
    return fused.select("path", "score", mode.alias("mode")).orderBy(F.desc("score"), "path").limit(top_k)


def hybrid_search(pages: DataFrame, chunks: DataFrame, query: str, vector: list[float] | None, top_k: int = 20) -> DataFrame:
    """The top_k pages by fused rank, or by keyword score when there are no vector hits.

    pages: path, title, file_name, content; chunks: vec_id, page (a path), embedding.
    """
    top_k = max(1, min(50, top_k))
    words = keyword_scores(pages, query)
    if vector is None:
        return words.select("path", "score", F.lit("keyword").alias("mode")).orderBy(F.desc("score"), "path").limit(top_k)
    return fused_pages(words, vector_pages(chunks, vector, top_k).withColumnRenamed("page", "path"), top_k)


def neighbours(chunks: DataFrame, own: int, vector: list[float], k: int = 8) -> DataFrame:
    """The k nearest other vectors of one vector."""
    return nearest(chunks, vector, k + 1).where(F.col("vec_id") != own).orderBy("distance", "vec_id").limit(k)


def pack_context(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows that a greedy pass keeps: in order, a row stays if it still fits the budget, else it is passed over.

    Each group is one ordered array folded inside the JVM; groups are bounded by what one answer can cite.
    """
    row = F.struct(*order, size)
    each = items.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(each.schema["rows"].dataType).alias("kept"))
    fold = F.aggregate(
        "rows", start,
        lambda s, r: F.when(
            s["used"] + r[size] <= budget, F.struct((s["used"] + r[size]).alias("used"), F.concat(s["kept"], F.array(r)).alias("kept"))
        ).otherwise(F.struct(s["used"].alias("used"), s["kept"].alias("kept"))),
    )
    return each.select(group, F.explode(fold["kept"]).alias("r")).select(group, "r.*")


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n user or assistant turns of each conversation."""
    own = turns.where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return own.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")
