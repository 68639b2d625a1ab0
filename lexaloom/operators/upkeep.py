"""Upkeep of pages and queues: canonical references, executed merges, citations, requeued tasks and graph extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaloom.functions import rewriting as R
from lexaloom.functions import text as T
from lexaloom.operators import dedup, graph

NONE = "array<string>"


def canonical_related(pages: DataFrame) -> DataFrame:
    """path and content of pages (path, content) whose related field names pages by their identifiers.

    Each item becomes what the cascade of graph.resolve_cascade finds, else
    stays; of items equal but for case the first stays. References are joined
    once each, and a page's own list is all that is put together again.
    """
    wanted = pages.select("path", F.posexplode(R.related_slugs(F.col("content"))).alias("at", "ref"))
    found = graph.resolve_cascade(wanted.select("ref"), pages.select(T.file_stem(F.col("path")).alias("id")))
    items = wanted.join(found, "ref", "left").select("path", "at", F.coalesce("id", "ref").alias("slug"))
    lists = items.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "slug"))).alias("r"))
    slugs = dedup.union_ignoring_case(F.transform("r", lambda x: x["slug"]), F.array().cast(NONE))
    joined = pages.select("path", "content").join(lists.select("path", slugs.alias("slugs")), "path", "left")
    return joined.select("path", F.when(F.col("slugs").isNull(), F.col("content")).otherwise(R.with_array(F.col("content"), "related", F.col("slugs"))).alias("content"))


def group_key(slugs: Column) -> Column:
    """One key for a group in whatever order and case."""
    return F.array_join(F.array_sort(F.transform(slugs, F.lower)), ",")


def unsuppressed(groups: DataFrame, not_duplicates: DataFrame) -> DataFrame:
    """groups (slugs) of two pages or more that are not among not_duplicates (slugs); both sides may repeat."""
    known = not_duplicates.select(group_key(F.col("slugs")).alias("key")).distinct()
    return groups.where(F.size("slugs") >= 2).withColumn("key", group_key(F.col("slugs"))).join(known, "key", "left_anti").dropDuplicates(["key"]).drop("key")


def execute_merge(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """path and content of pages (path, content) after pages are merged away; moves: old and new identifiers, each old once.

    Merged pages go. Links and related items that led to them lead to the new
    page, a page's own identifier leaves its related items, and the new page
    takes their tags, related items and sources in, its own first. A page is
    joined with the moves of its own references only.
    """
    slug, c = T.file_stem(F.col("path")), F.col("content")
    own = pages.select("path", "content", slug.alias("slug"), T.array_field(c, "tags").alias("tags"), R.related_slugs(c).alias("related"), T.array_field(c, "sources").alias("sources"))
    refs = own.select("path", F.explode(F.array_distinct(R.references(c))).alias("old"))
    turned = refs.join(moves.select("old", "new"), "old").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("old", "new"))).alias("moves"))
    group = moves.select(F.col("old").alias("slug"), F.col("new").alias("canonical"))
    group = group.unionByName(group.select(F.col("canonical").alias("slug"), "canonical")).distinct()
    united = dedup.merge_groups(own.select("slug", "tags", "related", "sources"), group)
    taken = united.join(moves.select(F.col("old").alias("item"), "new").groupBy("new").agg(F.collect_list(F.struct(F.col("item").alias("old"), "new")).alias("inner")), F.col("slug") == F.col("new"), "left")
    taken = taken.select("slug", *[F.col(n).alias(f"all_{n}") for n in ("tags", "related", "sources")], "inner")
    left = own.join(moves.select(F.col("old").alias("slug")).distinct(), "slug", "left_anti")
    j = left.join(turned, "path", "left").join(taken, "slug", "left")
    none = F.array().cast("array<struct<old:string,new:string>>")
    j = j.withColumn("every", F.array_distinct(F.concat(F.coalesce("moves", none), F.coalesce("inner", none))))
    new_of = lambda x: F.coalesce(F.get(F.filter("every", lambda m: m["old"] == x), F.lit(0))["new"], x)
    j = j.withColumn("items", dedup.union_ignoring_case(F.transform(F.coalesce("all_related", "related"), new_of), F.array().cast(NONE)))
    j = j.withColumn("all_related", F.filter("items", lambda x: x != F.col("slug"))).withColumn("text", R.relinked(c, F.col("every")))
    for name in ("related", "tags", "sources"):  # a column for each step, so that no text is computed more than once
        grown = F.col(f"all_{name}").isNotNull() & (F.col(f"all_{name}") != F.col(name))
        j = j.withColumn("text", F.when(grown, R.with_array(F.col("text"), name, F.col(f"all_{name}"))).otherwise(F.col("text")))
    return j.select("path", F.col("text").alias("content"))


def cited_pages(answers: DataFrame, context: DataFrame) -> DataFrame:
    """id, via, position and page of the pages that answers cite.

    answers: id, text; context: id, position (from 1), page. A `<!-- cited: 1, 2 -->`
    note counts first, else numbers in brackets, else wiki links; numbers without
    a page in the context do not count. Links have no position.
    """
    t = F.col("text")
    noted = F.transform(F.split(F.regexp_extract(t, r"<!--\s*cited:\s*(.+?)\s*-->", 1), ","), lambda x: F.regexp_extract(x, r"^\s*(\d{1,9})", 1))
    numbered = F.regexp_extract_all(t, F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    rows = lambda rank, via, found: answers.select("id", F.lit(rank).alias("rank"), F.lit(via).alias("via"), F.explode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("n"))
    numbers = rows(1, "note", noted).unionByName(rows(2, "number", numbered)).withColumn("position", F.col("n").cast("int"))
    pages = numbers.join(context.select("id", "position", "page"), ["id", "position"]).select("id", "rank", "via", "position", "page")
    links = rows(3, "link", T.link_targets(t)).select("id", "rank", "via", F.lit(None).cast("int").alias("position"), F.col("n").alias("page"))
    every = pages.unionByName(links).withColumn("best", F.min("rank").over(Window.partitionBy("id")))
    return every.where("rank = best").select("id", "via", "position", "page").distinct()


def first_seen(results: DataFrame, each: int = 5) -> DataFrame:
    """url, query and rank of the first place of each url among the first results of each query; results: query, rank, url."""
    first = results.where(F.col("rank") <= each).groupBy("url").agg(F.min(F.struct("query", "rank")).alias("f"))
    return first.select("url", "f.query", "f.rank")


#: Rows that a task of candidates sorts, unless one key has more.
TASK_ROWS = 1 << 19


def candidates(ranked: DataFrame, most: int = 30) -> DataFrame:
    """key, slug and place of at most ``most`` candidates of each key; ranked: key, tier, rank, slug.

    A slug counts once, at its first place: lower tiers first, then rank. Rows
    are dealt out by key once, to more tasks the more rows there are.
    """
    tasks = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranked.count() // TASK_ROWS))
    again = F.row_number().over(Window.partitionBy("key", "slug").orderBy("tier", "rank"))
    first = ranked.repartition(tasks, "key").withColumn("again", again).where(F.col("again") == 1)
    place = F.row_number().over(Window.partitionBy("key").orderBy("tier", "rank", "slug"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("key", "slug", "place")


def known_paths(gone: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Paths of the snapshot (path) that are among the gone (path) or lie in a folder that is; an equi-join on every folder of a path."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = snapshot.select("path", F.explode(folders).alias("folder"))
    return each.join(gone.select(F.col("path").alias("folder")).distinct(), "folder", "left_semi").select("path").distinct()


def recover(queue: DataFrame) -> DataFrame:
    """queue (status, ...) after a restart: tasks in processing are pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def retry(queue: DataFrame, which: Column | None = None) -> DataFrame:
    """queue (status, error, retry_count, needs_rerun) after failed tasks (or those that which holds for) are pending with fresh counters."""
    hit = F.coalesce((F.col("status") == "failed") if which is None else which, F.lit(False))
    fresh = {"status": F.lit("pending"), "error": F.lit(None).cast("string"), "retry_count": F.lit(0), "needs_rerun": F.lit(False)}
    return queue.select(*[F.when(hit, fresh[n]).otherwise(F.col(n)).alias(n) if n in fresh else F.col(n) for n in queue.columns])


def cancel(tasks: DataFrame, written: DataFrame, pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages (path) and chunks (page_id) without what cancelled tasks (task) wrote (task, path)."""
    gone = written.join(tasks.select("task").distinct(), "task", "left_semi").select("path").distinct()
    ids = gone.select(T.file_stem(F.col("path")).alias("page_id")).distinct()
    return pages.join(gone, "path", "left_anti"), chunks.join(ids, "page_id", "left_anti")


def graph_slice(nodes: DataFrame, edges: DataFrame, text: str = "", kind: str = "", most: int = 200) -> DataFrame:
    """src and dst of edges among the first nodes (id, label, type) by id whose id or label holds text and whose type is kind; most: 1 to 1000."""
    low = text.lower()
    hit = (F.contains(F.lower(F.col("id").cast("string")), F.lit(low)) | F.contains(F.lower("label"), F.lit(low))) if low else F.lit(True)
    kept = nodes.where(hit & ((F.lower("type") == kind.lower()) if kind else F.lit(True))).orderBy("id").limit(max(1, min(1000, most))).select("id")
    ends = F.broadcast(kept)  # at most 1000 rows
    return edges.join(ends.select(F.col("id").alias("src")), "src", "left_semi").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def display_weights(edges: DataFrame) -> DataFrame:
    """a, b, weight and size (0.5 to 4) of edges by their share of the largest weight, which is 1 at least."""
    most = edges.agg(F.greatest(F.max("weight").cast("double"), F.lit(1.0)).alias("m")).scalar()
    return edges.select("a", "b", "weight", (F.lit(0.5) + F.lit(3.5) * (F.col("weight") / most)).alias("size"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n and mark of a graph's nodes (id) and edges (src, dst): sums of hashes, the same in whatever order rows come."""
    mark = F.sum(F.conv(F.substring(F.md5(F.col("key")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    keys = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("key"))
    keys = keys.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")).alias("key")))
    return keys.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))
