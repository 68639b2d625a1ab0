"""Queries over the given tables, each with DuckDB SQL for the same rows.

Documents play wiki pages, embeddings chunk vectors, parts graph nodes (linked
where they follow each other in an order), events a change feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaloom.functions import text as T
from lexaloom.operators import changes, chunking, dedup, graph, linking, matching, neighbours, quality, relatedness, retrieval
from lexaloom.plans import maintenance, upkeep
from lexaloom.session import cut_statistics, dealt, shared_path, table, tasks_for
from lexaloom.sources import media
from lexaloom.sources import pages as page_sources
from lexaloom.streaming import feed, ingestion, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = "ing where"
FAR = 10**18


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def wiki_pages(spark: SparkSession, sf_dir: str, spread: int = False) -> DataFrame:
    """documents as pages: path, title, file_name, content."""
    d = table(spark, sf_dir, "documents", spread)
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(
        F.concat(F.lit("wiki/"), "source", F.lit("/"), name).alias("path"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        name.alias("file_name"), F.col("text").alias("content"),
    )


_PAGES = "(SELECT 'wiki/' || source || '/doc-' || doc_id || '.md' AS path, 'doc ' || doc_id AS title, 'doc-' || doc_id || '.md' AS file_name, text AS content FROM documents)"
_KEYWORD = f"""(SELECT path, title, CAST(200 * e + 50 * t + 20 * o + 5 * tt + ct AS DOUBLE) AS score, (tt > 0 OR t > 0) AS title_match FROM (
  SELECT path, title, CAST(regexp_replace(lower(file_name), '\\.md$', '') = 'ing where' AS INT) AS e,
    CAST(contains(lower(title || ' ' || file_name), 'ing where') AS INT) AS t,
    least(10, CAST((length(lower(content)) - length(replace(lower(content), 'ing where', ''))) / 9 AS INT)) AS o,
    CAST(contains(lower(title || ' ' || file_name), 'ing') AS INT) + CAST(contains(lower(title || ' ' || file_name), 'where') AS INT) AS tt,
    CAST(contains(lower(content), 'ing') AS INT) + CAST(contains(lower(content), 'where') AS INT) AS ct
  FROM {_PAGES}) WHERE 200 * e + 50 * t + 20 * o + 5 * tt + ct > 0)"""


@query(f"SELECT * FROM {_KEYWORD} ORDER BY score DESC, path LIMIT 20")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_scores(wiki_pages(spark, sf_dir), QUERY).orderBy(F.desc("score"), "path").limit(20)


@query(f"SELECT path, score, title_match FROM {_KEYWORD}")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_scores(wiki_pages(spark, sf_dir), QUERY).select("path", "score", "title_match")


@query(
    """SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the ', ''))) / 4 AS BIGINT) AS n_places,
    CASE WHEN instr(lower(text), 'the ') = 0 THEN '' ELSE replace(substr(text, greatest(instr(lower(text), 'the ') - 80, 1), least(instr(lower(text), 'the ') + 83, length(text)) - greatest(instr(lower(text), 'the ') - 80, 1) + 1), chr(10), ' ') END AS around
    FROM documents"""
)
def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    low = F.lower("text")
    plain = T.snippet(F.col("text"), ["the "])
    first = F.instr(low, "the ")
    cut = F.when(first == 0, "").otherwise(F.regexp_replace(F.regexp_replace(plain, F.when(first > 81, r"^\.\.\.").otherwise("^(?!)"), F.lit("")), F.when(first + 83 < F.length("text"), r"\.\.\.$").otherwise("^(?!)"), F.lit("")))
    return d.select("doc_id", T.occurrences(low, "the ").cast("long").alias("n_places"), cut.alias("around"))


@query(
    """SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^# +(.+?)\\s*$', 1), ''), replace('doc-' || doc_id, '-', ' ')) AS title FROM documents"""
)
def title_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = wiki_pages(spark, sf_dir)
    return p.select(F.regexp_extract("path", r"doc-(\d+)", 1).cast("long").alias("doc_id"), T.page_title(F.col("content"), F.col("path")).alias("title"))


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float], int]:
    """embeddings as chunks, the first vector as the query's, and its id."""
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).first()
    return e.select("vec_id", F.col("label").alias("page"), F.col("embedding").cast("array<double>").alias("embedding")), list(first["embedding"]), first["vec_id"]


_NEAR = """(SELECT vec_id, label AS page, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q.e[i] AS DOUBLE)))), 9) AS distance
  FROM embeddings, (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY distance, vec_id LIMIT {k})"""


@query(f"SELECT vec_id, page, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM {_NEAR.format(k=30)}")
def knn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q, _ = _chunks(spark, sf_dir)
    return retrieval.nearest(c, q, 30).select("vec_id", "page", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_BLEND = """(SELECT page, count(*) AS n_chunks, max(s) + least(0.3 * (sum(s) - max(s)), greatest(0, 1 - max(s))) AS score
  FROM (SELECT page, 1 / (1 + distance) AS s FROM {near}) GROUP BY page ORDER BY score DESC, page LIMIT 20)"""


@query(f"SELECT page, n_chunks, round(score, 6) AS score FROM {_BLEND.format(near=_NEAR.format(k=60))}")
def page_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q, _ = _chunks(spark, sf_dir)
    return retrieval.vector_pages(c, q, 20).select("page", "n_chunks", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, page, round(distance, 6) AS distance FROM {_NEAR.format(k=9)} WHERE vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY distance, vec_id LIMIT 8")
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q, own = _chunks(spark, sf_dir)
    return retrieval.neighbours(c, own, q, 8).select("vec_id", "page", F.round("distance", 6).alias("distance"))


@query(
    """WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT id, other, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), other) AS rank FROM p) WHERE rank <= 8"""
)
def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest other vectors of every vector, exactly."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest_join(e, 8, exact=True).select("id", "other", F.round("distance", 6).alias("distance"), "rank")


@query(
    f"""WITH kw AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS kr FROM {_KEYWORD}),
    v AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS vr FROM (
      SELECT path, max(s) + least(0.3 * (sum(s) - max(s)), greatest(0, 1 - max(s))) AS score
      FROM (SELECT p.path, 1 / (1 + distance) AS s FROM {_NEAR.format(k=60)} n JOIN (SELECT doc_id, path FROM (SELECT doc_id, 'wiki/' || source || '/doc-' || doc_id || '.md' AS path FROM documents)) p ON p.doc_id = n.vec_id)
      GROUP BY path ORDER BY score DESC, path LIMIT 20))
    SELECT path, round(score, 9) AS score, mode FROM (
      SELECT coalesce(kw.path, v.path) AS path, coalesce(1.0::DOUBLE / (60 + kr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0) AS score,
        CASE WHEN kr IS NULL THEN 'vector' WHEN vr IS NULL THEN 'keyword' ELSE 'hybrid' END AS mode
      FROM kw FULL OUTER JOIN v ON kw.path = v.path) ORDER BY score DESC, path LIMIT 20"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits on documents fused with vector hits; a vector's page is the document of its number."""
    e, q, _ = _chunks(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("wiki/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    near = retrieval.nearest(e, q, 60).join(d.select(F.col("doc_id").alias("vec_id"), path.alias("path")), "vec_id")
    hits = retrieval.blend_pages(near.select(F.col("path").alias("page"), "score"), 20).withColumnRenamed("page", "path")
    found = retrieval.fused_pages(retrieval.keyword_scores(wiki_pages(spark, sf_dir), QUERY), hits, 20)
    return found.select("path", F.round("score", 9).alias("score"), "mode")


@query(
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
    r AS (SELECT conv_id, k, turn, n, CASE WHEN n <= 1500 THEN n ELSE 0 END AS used, n <= 1500 AS kept FROM o WHERE k = 1
      UNION ALL SELECT o.conv_id, o.k, o.turn, o.n, CASE WHEN r.used + o.n <= 1500 THEN r.used + o.n ELSE r.used END, r.used + o.n <= 1500 FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
    SELECT conv_id, turn, n AS n_chars FROM r WHERE kept"""
)
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    return retrieval.pack_context(items, "conv_id", ["turn"], "n_chars", 1500)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant')) WHERE k <= 3")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.last_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def conversation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


# Graph queries

_EDGES = """(SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
_RELATED = """(SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS dst FROM part) WHERE dst IS NOT NULL)"""
_NODES = "(SELECT p_partkey AS id, p_name AS label, ['entity', 'concept', 'source', 'query', 'synthesis'][1 + p_size % 5] AS type, p_size % 8 AS community FROM part)"
_UNDIRECTED = f"(SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_EDGES})"
_COUNTS = f"(SELECT node, count(*) AS n_links FROM (SELECT src AS node FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY node)"


def line_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks want the rows of lineitem, and so the edges that are made of them."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directed edges from each part of an order to the next one."""
    w, tasks = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"), line_tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = dealt(lines, tasks, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return dealt(lines.where("dst IS NOT NULL AND src <> dst"), tasks, "src", "dst").distinct()


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of parts that an edge joins."""
    return graph.undirected(part_edges(spark, sf_dir), line_tasks(spark, sf_dir))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in graph.TYPES])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.element_at(kinds, 1 + F.col("p_size") % 5).alias("type"), (F.col("p_size") % 8).alias("community")
    )


def part_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(w).alias("dst")).where("dst IS NOT NULL")


def counted_nodes(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    counts = graph.link_counts(part_edges(spark, sf_dir) if edges is None else edges).withColumnRenamed("node", "id")
    return part_nodes(spark, sf_dir).join(counts, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


_COUNTED = f"(SELECT n.*, coalesce(n_links, 0) AS n_links FROM {_NODES} n LEFT JOIN {_COUNTS} c ON c.node = n.id)"


@query(f"SELECT * FROM {_EDGES}")
def edge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir)


@query(f"SELECT * FROM {_COUNTS}")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_counts(part_edges(spark, sf_dir))


def relevance_sql(edges: str, related: str, nodes: str, sources: str) -> str:
    return f"""(WITH e AS {edges}, r AS {related}, deg AS (SELECT node, count(*) AS n_links FROM (SELECT src AS node FROM {edges} UNION ALL SELECT dst FROM {edges}) GROUP BY node), n AS {nodes},
  pair AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT * FROM e UNION SELECT * FROM r)),
  near AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e UNION SELECT src, dst FROM r),
  direct AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS direct FROM e GROUP BY 1, 2),
  listed AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS listed FROM r GROUP BY 1, 2),
  src AS {sources},
  shared AS (SELECT a, b, count(*) AS shared FROM pair JOIN src x ON x.id = a JOIN src y ON y.id = b AND x.s = y.s GROUP BY a, b),
  aa AS (SELECT a, b, sum(1 / ln(greatest(coalesce(n_links, 0), 2))) AS adamic FROM pair JOIN near x ON x.x = a JOIN near y ON y.x = b AND x.y = y.y LEFT JOIN deg ON deg.node = x.y GROUP BY a, b),
  aff AS (SELECT * FROM (VALUES {", ".join(f"('{x}', '{y}', {graph.AFFINITY[i][j]})" for i, x in enumerate(graph.TYPES) for j, y in enumerate(graph.TYPES))}) v(x, y, f))
  SELECT pair.a, pair.b, coalesce(direct, 0) AS direct, coalesce(listed, 0) AS listed, coalesce(shared, 0) AS shared, coalesce(adamic, 0) AS adamic,
    (3 * coalesce(direct, 0) + 4.5::DOUBLE * coalesce(listed, 0) + 4 * coalesce(shared, 0) + 1.5::DOUBLE * coalesce(adamic, 0) + coalesce(f, 0.5)::DOUBLE) AS relevance
  FROM pair LEFT JOIN direct USING (a, b) LEFT JOIN listed USING (a, b) LEFT JOIN shared USING (a, b) LEFT JOIN aa USING (a, b)
  LEFT JOIN n na ON na.id = pair.a LEFT JOIN n nb ON nb.id = pair.b LEFT JOIN aff ON aff.x = na.type AND aff.y = nb.type)"""


_RELEVANCE = relevance_sql(_EDGES, _RELATED, _NODES, "(SELECT DISTINCT l_partkey AS id, l_suppkey AS s FROM lineitem)")


def part_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("source"))
    return graph.relevance(part_nodes(spark, sf_dir), part_edges(spark, sf_dir), part_related(spark, sf_dir), sources)


@query(f"SELECT a, b, direct, listed, shared, round(adamic, 4) AS adamic, round(relevance, 4) AS relevance FROM {_RELEVANCE}")
def relevance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = part_relevance(spark, sf_dir)
    return r.select("a", "b", "direct", "listed", "shared", F.round("adamic", 4).alias("adamic"), F.round("relevance", 4).alias("relevance"))


@query(
    "SELECT a, b, direct, listed, shared, round(adamic, 4) AS adamic, round(relevance, 4) AS relevance FROM "
    + relevance_sql(upkeep.PAGE_EDGES, upkeep.PAGE_RELATED, upkeep.PAGE_NODES, upkeep.PAGE_SOURCES)
)
def page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From page texts to scored links: links and related items by the cascade, sources and types from front matter."""
    r = graph.relevance(*_page_tables(spark, sf_dir))
    return r.select("a", "b", "direct", "listed", "shared", F.round("adamic", 4).alias("adamic"), F.round("relevance", 4).alias("relevance"))


def _page_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes, edges, related and sources of the linked pages."""
    p = upkeep.linked_pages(spark, sf_dir).withColumn("id", T.file_stem(F.col("path")))
    refs = lambda items: p.select("id", F.explode(F.array_distinct(items)).alias("target"))
    links, listed = refs(T.link_targets(T.body_of(F.col("content")))), refs(T.array_field(F.col("content"), "related"))
    found = cut_statistics(graph.resolve_cascade(links.unionByName(listed).select(F.col("target").alias("ref")), p.select("id")))
    sources = p.select("id", F.explode(T.array_field(F.col("content"), "sources")).alias("source"))
    return p.select("id", T.page_type(F.col("content")).alias("type")), graph.edges_of(links, found), graph.edges_of(listed, found), sources


def all_relevance_sql(edges: str, related: str, nodes: str, sources: str, k: int) -> str:
    """The k most relevant other nodes of each node, from every pair of nodes."""
    return f"""WITH e AS {edges}, r AS {related}, n AS {nodes}, src AS {sources},
  deg AS (SELECT node, count(*) AS n_links FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
  near AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e UNION SELECT src, dst FROM r),
  part AS (
    SELECT src AS a, dst AS b, 3.0::DOUBLE AS v FROM e UNION ALL SELECT dst, src, 3 FROM e UNION ALL SELECT src, dst, 4.5 FROM r UNION ALL SELECT dst, src, 4.5 FROM r
    UNION ALL SELECT p.id, q.id, 4 FROM src p JOIN src q ON p.s = q.s
    UNION ALL SELECT p.x, q.x, 1.5 / ln(greatest(coalesce(n_links, 0), 2)) FROM near p JOIN near q ON p.y = q.y LEFT JOIN deg ON deg.node = p.y
  ), total AS (SELECT a, b, sum(v) AS v FROM part WHERE a <> b GROUP BY a, b),
  aff AS (SELECT * FROM (VALUES {", ".join(f"('{x}', '{y}', {graph.AFFINITY[i][j]})" for i, x in enumerate(graph.TYPES) for j, y in enumerate(graph.TYPES))}) t(x, y, f))
  SELECT node, other, relevance, rank FROM (
    SELECT p.id AS node, q.id AS other, round(coalesce(v, 0) + coalesce(f, 0.5)::DOUBLE, 6) AS relevance, row_number() OVER (PARTITION BY p.id ORDER BY round(coalesce(v, 0) + coalesce(f, 0.5)::DOUBLE, 6) DESC, q.id) AS rank
    FROM n p JOIN n q ON p.id <> q.id LEFT JOIN total ON a = p.id AND b = q.id LEFT JOIN aff ON aff.x = p.type AND aff.y = q.type
  ) WHERE rank <= {k}"""


@query(all_relevance_sql(upkeep.PAGE_EDGES, upkeep.PAGE_RELATED, upkeep.PAGE_NODES, upkeep.PAGE_SOURCES, 5))
def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most relevant other pages of every page, linked or not, from page texts."""
    return relatedness.related_pages(*_page_tables(spark, sf_dir), k=5, hub=24)


@query(
    f"""SELECT node, other, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY relevance DESC, other) AS rank FROM (
    SELECT a AS node, b AS other, round(relevance, 4) AS relevance FROM {_RELEVANCE} UNION ALL SELECT b, a, round(relevance, 4) FROM {_RELEVANCE})) WHERE rank <= 3"""
)
def top_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = part_relevance(spark, sf_dir).withColumn("relevance", F.round("relevance", 4))
    return graph.top_related(scored, 3).select("node", "other", "relevance", "rank")


@query(
    f"""WITH n AS {_NODES}, e AS {_UNDIRECTED},
    i AS (SELECT x.community, count(*) AS k FROM e JOIN n x ON x.id = e.a JOIN n y ON y.id = e.b WHERE x.community = y.community GROUP BY 1)
    SELECT community, count(*) AS n_nodes, coalesce(any_value(k), 0) AS n_inner, round(coalesce(any_value(k), 0) / greatest(count(*) * (count(*) - 1) / 2, 1), 6) AS cohesion
    FROM n LEFT JOIN i USING (community) GROUP BY community"""
)
def community_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cohesion(part_nodes(spark, sf_dir), part_pairs(spark, sf_dir), line_tasks(spark, sf_dir))


@query(
    f"""SELECT community, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n_links DESC, id) AS k FROM {_COUNTED}) WHERE k <= 5 GROUP BY community"""
)
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_members(counted_nodes(spark, sf_dir))


@query(
    f"""WITH n AS {_COUNTED}, m AS (SELECT greatest(max(n_links), 1) AS most FROM n)
    SELECT a, b, score FROM (SELECT a, b, CASE WHEN x.community <> y.community THEN 3 ELSE 0 END
      + CASE WHEN (x.type, y.type) IN (('source', 'concept'), ('concept', 'source'), ('source', 'synthesis'), ('synthesis', 'source'), ('query', 'entity'), ('entity', 'query')) THEN 2 WHEN x.type <> y.type THEN 1 ELSE 0 END
      + CASE WHEN least(x.n_links, y.n_links) <= 2 AND greatest(x.n_links, y.n_links) * 2 >= most THEN 2 ELSE 0 END + 1 AS score
      FROM {_UNDIRECTED} e JOIN n x ON x.id = a JOIN n y ON y.id = b, m) WHERE score >= 3 ORDER BY score DESC, a, b LIMIT 5"""
)
def surprising_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_pairs(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return graph.surprising(counted_nodes(spark, sf_dir), edges)


@query(
    f"""WITH n AS {_COUNTED}, e AS {_UNDIRECTED},
    i AS (SELECT x.community AS c, count(*) AS k FROM e JOIN n x ON x.id = e.a JOIN n y ON y.id = e.b WHERE x.community = y.community GROUP BY 1),
    coh AS (SELECT community, count(*) AS nn, round(coalesce(any_value(k), 0) / greatest(count(*) * (count(*) - 1) / 2, 1), 6) AS cohesion FROM n LEFT JOIN i ON i.c = n.community GROUP BY community),
    br AS (SELECT s.id, count(DISTINCT community) AS k FROM (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e) s JOIN n ON n.id = s.other GROUP BY s.id HAVING count(DISTINCT community) >= 3 ORDER BY k DESC, s.id LIMIT 3)
    SELECT kind, subject, value FROM (
      SELECT 1 AS o, 'isolated' AS kind, CAST(0 AS BIGINT) AS subject, CAST(count(*) AS DOUBLE) AS value FROM n WHERE n_links <= 1 HAVING count(*) > 0
      UNION ALL SELECT 2, 'sparse', CAST(community AS BIGINT), cohesion FROM coh WHERE cohesion < 0.15 AND nn >= 3
      UNION ALL SELECT 3, 'bridge', CAST(id AS BIGINT), CAST(k AS DOUBLE) FROM br) ORDER BY o, value, subject LIMIT 8"""
)
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and their pairs are written, as several branches read them."""
    tasks = line_tasks(spark, sf_dir)
    edges = cut_statistics(part_edges(spark, sf_dir))
    return graph.gaps(counted_nodes(spark, sf_dir, edges), cut_statistics(graph.undirected(edges, tasks)), tasks=tasks)


@query(
    f"""WITH n AS (SELECT * FROM {_COUNTED} WHERE type <> 'query' AND n_links <= 60 AND n_links > 0)
    SELECT a, b FROM {_UNDIRECTED} WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)"""
)
def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible(counted_nodes(spark, sf_dir), part_pairs(spark, sf_dir), ["query"], 60)[1].select("a", "b")


@query(f"SELECT id, label, type FROM {_NODES} WHERE contains(lower(label || ' ' || id || ' ' || type), 'gear') AND contains(lower(label || ' ' || id || ' ' || type), '7')")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search_nodes(part_nodes(spark, sf_dir), "gear 7").select("id", "label", "type")


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_pairs(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return graph.communities(edges)


@query()
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_relevance(spark, sf_dir).select("a", "b", F.col("relevance").alias("weight"))
    return graph.louvain(edges)


@query(
    f"""WITH n AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 11 <> 0), e AS (SELECT * FROM {_RELATED} WHERE src % 11 <> 0 AND src % 5 <> 0)
    SELECT 'orphan' AS rule, 'info' AS severity, CAST(id AS VARCHAR) AS subject, '' AS detail FROM n WHERE id NOT IN (SELECT dst FROM e WHERE dst % 11 <> 0)
    UNION ALL SELECT 'no-outlinks', 'info', CAST(id AS VARCHAR), '' FROM n WHERE id NOT IN (SELECT src FROM e WHERE dst % 11 <> 0)
    UNION ALL SELECT DISTINCT 'broken-link', 'warning', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM e WHERE dst NOT IN (SELECT id FROM n)"""
)
def structural_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related parts as links, where every eleventh part has no page and every fifth has no links of its own."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).where("id % 11 <> 0")
    links = part_related(spark, sf_dir).where("src % 11 <> 0 AND src % 5 <> 0")
    known = nodes.select(F.col("id").alias("dst"))
    broken = links.join(known, "dst", "left_anti").select(F.col("src").alias("id"), F.col("dst").alias("target"))
    return quality.lint(nodes, links.join(known, "dst", "left_semi").select("src", "dst"), broken)


@query(
    """WITH ids AS (SELECT DISTINCT replace(lower(p_brand), '#', '-') || '-' || p_partkey AS id FROM part), refs AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS ref FROM part UNION SELECT DISTINCT p_brand || '-' || p_partkey FROM part),
    r AS (SELECT ref, replace(lower(ref), ' ', '-') AS norm FROM refs),
    l AS (SELECT ref, id, 2 AS lv FROM r JOIN ids ON id = norm
      UNION ALL SELECT ref, id, 4 FROM r JOIN (SELECT id, unnest(list_transform(range(1, len(string_split(id, '-')) + 1), lambda i: array_to_string(string_split(id, '-')[i:], '-'))) AS k FROM ids) s ON s.k = norm
      UNION ALL SELECT ref, id, 5 FROM r JOIN (SELECT id, unnest(list_transform(range(1, len(string_split(id, '-')) + 1), lambda i: array_to_string(string_split(id, '-')[:i], '-'))) AS k FROM ids) s ON s.k = norm),
    u AS (SELECT ref, lv, min(id) AS id FROM l GROUP BY ref, lv HAVING count(DISTINCT id) = 1)
    SELECT refs.ref, (SELECT u.id FROM u WHERE u.ref = refs.ref ORDER BY lv LIMIT 1) AS id FROM refs"""
)
def resolver_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    ids = p.select(F.concat_ws("-", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), key).alias("id"))
    refs = p.select(key.alias("ref")).union(p.select(F.concat_ws("-", "p_brand", key))).distinct()
    return graph.resolve_cascade(refs, ids)


# Names, deduplication, quality


@query(
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(p_name, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1-\\2', 'g')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
    lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]+', '', 'g')) AS key FROM part"""
)
def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.page_id(F.col("p_name")).alias("slug"), T.dedup_key(F.col("p_name")).alias("key"))


@query(
    """SELECT key, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (
    SELECT DISTINCT lower(regexp_replace(name, '[^\\p{L}\\p{N}]+', '', 'g')) AS key, name FROM (SELECT p_brand || ' ' || p_type AS name FROM part UNION ALL SELECT lower(p_brand || '-' || p_type) FROM part)) WHERE key <> '' GROUP BY key HAVING count(*) > 1"""
)
def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select(F.concat_ws(" ", "p_brand", "p_type").alias("name")).union(p.select(F.lower(F.concat_ws("-", "p_brand", "p_type"))))
    return dedup.clusters(names)


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("s"), F.length("text").alias("c"))
    return d.groupingSets([("source", "lang"), ("source",), ("lang",), ()], "source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("n_texts"), F.sum("c").alias("n_chars")
    )


@query(
    """SELECT ps AS id, CASE WHEN n_left = n THEN 'keep' WHEN n_left = 0 THEN 'delete' ELSE 'rewrite' END AS fate, n_left FROM (
    SELECT l_partkey AS ps, count(DISTINCT l_suppkey) AS n, count(DISTINCT CASE WHEN l_suppkey <> 7 THEN l_suppkey END) AS n_left FROM lineitem GROUP BY l_partkey)"""
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("sources"))
    return dedup.delete_source(pages, "7").select("id", "fate", F.size("sources").cast("long").alias("n_left"))


@query(
    """SELECT l_orderkey, array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(k := k, f := f)))), lambda x: x.f), ',') AS flags FROM (
    SELECT l_orderkey, min(l_linenumber) AS k, l_returnflag AS f FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey"""
)
def array_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of an order's lines, in the order of their first use, united over two halves of the lines ignoring case."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"))
    each = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "f"))).alias("r"))
    names = F.transform("r", lambda x: x["f"])
    half = F.floor((F.size("r") + 1) / 2).cast("int")
    first, second = F.slice(names, F.lit(1), half), F.slice(names, half + 1, F.size("r"))
    return each.select("l_orderkey", F.array_join(dedup.union_ignoring_case(first, second), ",").alias("flags"))


# The ladder once more, as patterns of DuckDB (whose word edges are those of ASCII words), from the same fixed values.
_SCRIPT_ROWS = ", ".join(f"('{name}', '[^{p}]')" for name, p in T.SCRIPTS.items())
_LATIN_CASES = " ".join(
    "WHEN " + " AND ".join([f"regexp_matches(low, '{letters}')"] * bool(letters) + [rf"regexp_matches(low, '\b({words})\b')"] * bool(words)) + f" THEN '{name}'"
    for name, letters, words in T.LATIN
)
_ARABIC_SCORE = lambda marks: " + ".join(
    [f"{n} * length(regexp_replace(text, '[^{p[1:]}', '', 'g'))" for p, n in marks[0]] + [f"2 * CAST(contains(spaced, ' {w} ') AS INT)" for w in marks[1]]
)


@query(
    f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS spaced FROM documents),
    n AS (SELECT doc_id, name, length(regexp_replace(text, p, '', 'g')) AS k, instr(text, substr(regexp_replace(text, p, '', 'g'), 1, 1)) AS place
      FROM documents, (VALUES {_SCRIPT_ROWS}) s(name, p) WHERE regexp_matches(text, '[^\\x00-\\x{{36F}}]')),
    best AS (SELECT doc_id, arg_min(name, (-k, place)) AS name, max(k) AS k, bool_or(name = 'Japanese' AND k > 0) AND bool_or(name = 'Chinese' AND k > 0) AS kanji FROM n WHERE k > 0 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN kanji THEN 'Japanese'
      WHEN k >= 2 AND name = 'Arabic' AND {_ARABIC_SCORE(T.PERSIAN)} >= 3 AND {_ARABIC_SCORE(T.PERSIAN)} > {_ARABIC_SCORE(T.ARABIC)} THEN 'Persian'
      WHEN k >= 2 THEN name {_LATIN_CASES} ELSE 'English' END AS language
    FROM d LEFT JOIN best USING (doc_id)"""
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=4).select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query(
    """SELECT doc_id, i AS start, substr(text, i + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 900)) AS i FROM documents WHERE length(text) > 0)"""
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(chunking.windows(F.col("text"), 1000, 100)).alias("w")).select("doc_id", F.col("w.start").cast("long").alias("start"), "w.text")


@query("SELECT p_brand, p_name, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 20) AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def entity_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.batches(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey", 20).select("p_brand", "p_name", "batch")


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"))
    return chunking.chunk_pages(d)


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1))) AS BIGINT) AS n_links FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", page_sources.html_title(F.col("html")).alias("title"), F.size(page_sources.html_links(F.col("html"))).cast("long").alias("n_links"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sources.clip_pages(table(spark, sf_dir, "pages"))


@query(
    """SELECT b.item_id, count(*) AS n_documents, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id"""
)
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold word for word."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("part"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pairs = matching.containing(d, b)
    return pairs.groupBy(F.col("key").alias("item_id")).agg(F.count(F.lit(1)).alias("n_documents"), F.min("id").alias("first_doc"))


@query(
    """SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(quality) - avg(toxic), 6) AS delta
    FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    q, t = F.avg("quality"), F.avg("toxic")
    return j.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(q, 6).alias("quality"), F.round(t, 6).alias("toxic"), F.round(q - t, 6).alias("delta"))


# Change feeds on events

_US = "epoch_us(ts)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    """WITH b AS (SELECT user_id, max(value) AS v FROM events WHERE ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1), a AS (SELECT user_id, max(value) AS v FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) GROUP BY 1)
    SELECT * FROM (SELECT coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'Created' WHEN a.user_id IS NULL THEN 'Deleted' WHEN a.v <> b.v THEN 'Modified' END AS kind
    FROM b FULL JOIN a ON a.user_id = b.user_id) WHERE kind IS NOT NULL"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(spark, sf_dir)
    ends = e.agg(F.min("at"), F.max("at")).first()
    middle = ends[0] + (ends[1] - ends[0]) // 2
    state = lambda rows: rows.groupBy("user_id").agg(F.max("value").alias("value"))
    return changes.snapshot_diff(state(e.where(F.col("at") < middle)), state(e.where(F.col("at") >= middle)), "user_id", ["value"])


_KIND = "CASE event_type WHEN 'view' THEN 'Modified' WHEN 'click' THEN 'Created' ELSE 'Deleted' END"


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    r AS (SELECT user_id, k, n, kind FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, o.n, CASE WHEN o.kind = 'Modified' OR (r.kind = 'Deleted' AND o.kind = 'Created') OR (r.kind = 'Created' AND o.kind = 'Deleted') THEN 'Modified' ELSE o.kind END
      FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, n, kind FROM r WHERE k = n"""
)
def kind_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Modified").when(F.col("event_type") == "click", "Created").otherwise("Deleted")
    e = timed(spark, sf_dir).select("user_id", "at", "event_id", kind.alias("kind"))
    return changes.coalesce_changes(e, "user_id", ["at", "event_id"])


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, {_US} AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, CAST(0 AS BIGINT) AS n_recent, [u] AS hits FROM o WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, CAST(len(f) AS BIGINT), CASE WHEN len(f) < 2 THEN list_append(f, u) ELSE f END
      FROM (SELECT o.user_id, o.event_id, o.k, o.u, list_filter(r.hits, lambda x: x >= o.u - 86400000000) AS f FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
    SELECT event_id, n_recent, n_recent < 2 AS allowed FROM r"""
)
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.rate_limited(timed(spark, sf_dir), "user_id", "event_id", "at", 2, 86_400_000_000).select("event_id", "n_recent", "allowed")


@query(
    f"""WITH c AS (SELECT user_id, event_id, {_US} AS at FROM events WHERE event_type <> 'purchase'), w AS (SELECT user_id, {_US} AS at FROM events WHERE event_type = 'purchase')
    SELECT user_id, event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = c.user_id AND w.at <= c.at AND c.at - w.at <= 86400000000)"""
)
def self_write_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(spark, sf_dir)
    own = F.col("event_type") == "purchase"
    return changes.suppress_own(e.where(~own).select("user_id", "at", "event_id"), e.where(own).select("user_id", "at"), "user_id", 86_400_000_000).select("user_id", "event_id")


@query(
    f"""SELECT user_id, min(u) AS session_start, max(u) AS session_end, count(*) AS n FROM (
    SELECT user_id, u, sum(CASE WHEN gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY u, event_id) AS run FROM (
    SELECT user_id, event_id, {_US} AS u, {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, run"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.sessions(timed(spark, sf_dir), "user_id", "at", 43_200_000_000)


@query(f"SELECT {_US} // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(spark, sf_dir)
    return e.groupBy(F.floor(F.col("at") / 3_600_000_000).alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(f"SELECT event_type, count(DISTINCT {_US} // 3600000000) AS n_windows, count(*) AS n FROM events GROUP BY event_type")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hourly windows, counted by a stream that runs over the table once and stops."""
    hours = feed.hourly_counts(spark, f"{sf_dir}/events.parquet")
    return hours.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'processing' END AS status, count(*) AS n FROM orders GROUP BY 1"""
)
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return changes.queue_summary(table(spark, sf_dir, "orders").select(status.alias("status")))


@query(
    """WITH q AS (SELECT 'o' || o_custkey AS path, CASE WHEN max(o_orderstatus) = 'F' THEN 'failed' WHEN max(o_orderstatus) = 'O' THEN 'pending' ELSE 'processing' END AS status, CAST(count(*) % 5 AS INT) AS r FROM orders GROUP BY o_custkey),
    i AS (SELECT 'o' || c_custkey AS path FROM customer)
    SELECT coalesce(q.path, i.path) AS path, CASE WHEN i.path IS NULL OR status = 'processing' THEN status WHEN status = 'failed' AND r >= 3 THEN status ELSE 'pending' END AS status, coalesce(r, 0) AS retry_count,
    coalesce(i.path IS NOT NULL AND status = 'processing', false) AS needs_rerun FROM q FULL JOIN i ON i.path = q.path"""
)
def task_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("s") == "F", "failed").when(F.col("s") == "O", "pending").otherwise("processing")
    q = o.select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("path"), status.alias("status"), (F.col("n") % 5).cast("int").alias("retry_count"), F.lit(False).alias("needs_rerun"))
    return changes.upsert_tasks(q, table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("path")))


@query(
    """SELECT key, title FROM (SELECT 'user-' || user_id AS key, event_type || ' ' || event_id AS title, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
    WHERE k = 1 AND event_type <> (SELECT min(event_type) FROM events)"""
)
def registry_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all events as changes, in four batches of which one is run twice, with a compaction between; the first kind of event removes."""
    e = table(spark, sf_dir, "events")
    first, last, gone = e.agg(F.min("event_id"), F.max("event_id"), F.min("event_type")).first()
    changes = e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("event_type") == gone, registry.REMOVE).otherwise(registry.UPSERT).alias("op"), F.col("event_id").alias("at"),
    )
    kept = registry.Registry(spark, shared_path(e, "registry"), changes.select("key", "title").schema)
    size = (last - first) // 4 + 1
    for batch in (0, 1, 1, 2, 0, 3):
        kept.apply(batch, changes.where((F.col("at") - first >= batch * size) & (F.col("at") - first < (batch + 1) * size)))
        if batch == 2:
            kept.compact()
    return kept.state()


@query(
    """WITH k AS (SELECT o_custkey AS c, count(*) AS size, max(o_orderkey) AS mtime, CAST(count(*) % 5 AS INT) AS tried, max(o_orderstatus) = 'P' AS failed FROM orders GROUP BY 1),
    s AS (SELECT o_custkey AS c, count(*) AS size, max(o_orderkey) AS mtime FROM orders WHERE o_totalprice > 30000 GROUP BY 1)
    SELECT 'c' || coalesce(k.c, s.c) AS path, CASE WHEN s.c IS NULL THEN 'gone' WHEN s.size = k.size AND s.mtime = k.mtime THEN CASE WHEN failed AND tried < 3 THEN 'retry' ELSE 'same' END WHEN s.size > 15 THEN 'large' ELSE 'read' END AS action,
    CASE WHEN s.size = k.size AND s.mtime = k.mtime AND failed AND tried < 3 THEN tried ELSE 0 END AS tried FROM k FULL JOIN s ON k.c = s.c"""
)
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingestion does with each file: customers are files, their orders bytes, of which the scan sees those above a price."""
    o = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    stat = lambda df: df.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.max("o_orderkey").alias("mtime"), F.max("o_orderstatus").alias("s"))
    known = stat(o).select(
        "path", "size", "mtime", F.sha2("path", 256).alias("hash"), (F.col("size") % 5).cast("int").alias("tried"), F.when(F.col("s") == "P", "no text").alias("error"), F.lit(0).cast("long").alias("texts")
    )
    return ingestion.plan(stat(o.where("o_totalprice > 30000")), known, tries=3, most_bytes=15).select("path", "action", "tried")


@query(
    """WITH s AS (SELECT source, 'media/' || left(sha256(source), 32) || '.png' AS url, sha256(source) AS h FROM (SELECT DISTINCT source FROM documents)),
    d AS (SELECT doc_id, source, CAST(least(doc_id % 4, 2) AS INT) AS n FROM documents)
    SELECT 'doc-' || doc_id AS path, k AS "at", 'picture ' || k AS alt, url, CASE k WHEN 0 THEN 'Of ' || source || ':' ELSE 'and' END AS before, CASE WHEN k + 1 < n THEN 'and' ELSE 'end' END AS after, h AS sha256, 'in/' || source || '.docx' AS source, CAST(2 AS BIGINT) AS n_files
    FROM (SELECT *, CAST(unnest(range(0, n)) AS INT) AS k FROM d) JOIN s USING (source)"""
)
def image_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in pages made of documents, with their text around and the files that show the same picture."""
    d = table(spark, sf_dir, "documents")
    own = d.select("source").distinct().withColumn("sha256", F.sha2("source", 256))
    shown = own.select("sha256", F.concat("source", F.lit(".PNG")).alias("name"), F.explode(F.array(F.lit("docx"), F.lit("pptx"))).alias("kind"), F.concat(F.lit("in/"), "source").alias("p"))
    shown = shown.select("sha256", "name", F.concat("p", F.lit("."), "kind").alias("path"))
    image = lambda k: F.concat(F.lit(f"![picture {k}](media/"), F.substring(F.sha2("source", 256), 1, 32), F.lit(".png)"))
    n = F.least(F.col("doc_id") % 4, F.lit(2))
    first, second = F.when(n > 0, image(0)).otherwise(""), F.when(n > 1, F.concat(F.lit(" and "), image(1))).otherwise("")
    content = F.concat(F.lit("Of "), "source", F.lit(":\n"), first, second, F.lit(" end"))
    return media.image_results(d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")), shown)


for part in (maintenance, upkeep):
    QUERIES.update(part.QUERIES)
    ORACLE_SQL.update(part.ORACLE_SQL)


@query()
def link_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with links to the test items whose first two words they mention: path, n_added and the new text's SHA-256."""
    item = table(spark, sf_dir, "benchmark")
    title = F.regexp_extract("text", r"([\p{L}\p{N}]+ [\p{L}\p{N}]+)", 1)
    targets = item.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("slug"), title.alias("title"))
    done = linking.link_pages(wiki_pages(spark, sf_dir, spread=4), targets)
    return done.select("path", "n_added", F.sha2("content", 256).alias("content_sha256"))
