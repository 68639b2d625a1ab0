"""Queries of page upkeep, reviews, vectors, paths and scores over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.functions import markup as M
from lexaloom.functions import paths as P
from lexaloom.functions import text as T
from lexaloom.operators import evals, listing, ontology, quality, reviews, vectors
from lexaloom.session import table


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as wiki pages with front matter, links to the parts of the same brand before them, and lists."""
    p = table(spark, sf_dir, "part", spread=4)
    folder = F.when(F.col("p_size") % 2 == 0, "entities").otherwise("concepts")
    slug = F.concat(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-"), (F.col("p_partkey") % 1000).cast("string"))
    kind = F.when(F.col("p_size") % 7 == 0, "source").when(F.col("p_size") % 2 == 0, "entity").otherwise("concept")
    content = F.concat(
        F.lit("---\ntitle: "), "p_name", F.lit("\ntype: "), kind, F.lit("\ncreated: 2024-01-"), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0"),
        F.lit("\nrelated: [size-"), (F.col("p_size") % 5).cast("string"), F.lit(", \"Brand One\"]\n---\n\n# "), "p_name", F.lit("\n\n- [["), "p_brand", F.lit("|the brand]] of it\nsee [["), "p_type", F.lit("]]\n"),
    )
    return p.select("p_partkey", F.concat(F.lit("wiki/"), folder, F.lit("/"), slug, F.lit(".md")).alias("path"), content.alias("content"))


_MADE = """(SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size % 2 = 0 THEN 'entities' ELSE 'concepts' END AS folder,
  regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || (p_partkey % 1000) AS slug,
  CASE WHEN p_size % 7 = 0 THEN 'source' WHEN p_size % 2 = 0 THEN 'entity' ELSE 'concept' END AS kind FROM part)"""

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT p_partkey, p_name AS title, kind AS type, p_brand || ',' || p_type AS links, 'size-' || (p_size % 5) || ',Brand One' AS related FROM {_MADE}")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = F.col("content"), F.col("path")
    return made_pages(spark, sf_dir).select(
        "p_partkey", T.page_title(c, p).alias("title"), T.page_type(c).alias("type"), F.array_join(T.link_targets(c), ",").alias("links"), F.array_join(T.array_field(c, "related"), ",").alias("related")
    )


@query(
    f"""SELECT 'wiki/' || folder || '/' || slug || '.md' AS path, 'hard' AS level, 'type-directory-mismatch' AS violation FROM {_MADE} WHERE kind = 'source'"""
)
def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(made_pages(spark, sf_dir).select("path", "content"))


@query(
    f"""WITH m AS {_MADE}, f AS (
      SELECT 'FRONTMATTER-INCONSISTENT-LIST' AS rule, 'warning' AS severity, 'wiki/' || folder || '/' || slug || '.md' AS subject, 'Brand One' AS detail FROM m
      UNION ALL SELECT 'TITLE-SLUG-MISMATCH', 'warning', 'wiki/' || folder || '/' || slug || '.md', array_to_string(list_filter(string_split(slug, '-'), lambda t: NOT list_contains(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), t)), ',') FROM m
      UNION ALL SELECT 'LINK-TITLE-FORM', 'warning', 'wiki/' || folder || '/' || slug || '.md', unnest([p_brand, p_type]) FROM m
      UNION ALL SELECT unnest(CASE WHEN regexp_matches(key, '[0-9]') THEN ['DUP-SLUG-PUNCTUATION', 'DUP-SLUG-VERSION-NUMBER'] ELSE ['DUP-SLUG-PUNCTUATION'] END), 'warning', key, slugs FROM (
        SELECT replace(slug, '-', '') AS key, string_agg(DISTINCT slug, ',' ORDER BY slug) AS slugs FROM m GROUP BY replace(slug, '-', '') HAVING count(DISTINCT slug) > 1))
    SELECT * FROM f"""
)
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit(made_pages(spark, sf_dir).select("path", "content"))


@query(f"SELECT DISTINCT slug FROM {_MADE} WHERE folder = 'concepts' AND slug IN (SELECT slug FROM {_MADE} WHERE folder = 'entities')")
def type_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.type_collisions(made_pages(spark, sf_dir))


@query("SELECT '2024-01-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS created, count(*) AS n FROM part GROUP BY 1")
def created_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.created_histogram(made_pages(spark, sf_dir))


@query(
    f"""SELECT folder AS section, row_number() OVER (PARTITION BY folder ORDER BY p_name, folder || '/' || slug) AS position, '- [[' || folder || '/' || slug || '|' || p_name || ']]' AS line FROM {_MADE}"""
)
def fresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.index_lines(listing.listing(made_pages(spark, sf_dir).select("path", "content")))


@query("SELECT DISTINCT 'size-' || (p_size % 5) AS title FROM part UNION SELECT 'Brand One'")
def dangling_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.dangling(made_pages(spark, sf_dir).select("path", "content"))


@query("SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.repeated_lines(table(spark, sf_dir, "documents").select(F.col("text").alias("content")))


@query(
    """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host,
    array_to_string(string_split(regexp_replace(regexp_replace(url, '/{2,}', '/', 'g'), '/$', ''), '/')[:-2], ' > ') AS trail FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.hostname(F.col("url")).alias("host"), P.folder_context(F.col("url")).alias("trail"))


@query(
    """SELECT o_orderpriority AS type, lower(trim(o_orderstatus)) AS key, max_by('order ' || o_orderkey, o_orderkey) AS description, min(o_orderkey) AS first_key, count(DISTINCT o_custkey) AS n_affected FROM orders GROUP BY 1, 2"""
)
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("title"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.array(F.col("o_custkey").cast("string")).alias("affected"), F.col("o_orderkey").alias("created_at"), F.lit(False).alias("resolved"),
    )
    return reviews.merge(o).select("type", T.review_title(F.col("title")).alias("key"), "description", F.col("id").alias("first_key"), F.size("affected").cast("long").alias("n_affected"))


@query("SELECT count(*) AS n_chunks, count(DISTINCT label) AS n_pages, count(DISTINCT len(embedding)) AS n_sizes FROM embeddings")
def vector_store_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page_id"), F.col("embedding").alias("vector"))
    return vectors.sizes(e)


@query("SELECT label AS page_id, count(*) AS n FROM (SELECT label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id < 10) UNION ALL SELECT label FROM embeddings WHERE vec_id < 10) GROUP BY 1")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten vectors replace all vectors of their pages."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page_id"), F.col("embedding").alias("vector"))
    return vectors.upsert_chunks(e, e.where("chunk_id < 10")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, CAST(5 * ((length(lower(source)) - length(replace(lower(source), 'src1', ''))) / 4) + least(10, (length(lower(text)) - length(replace(lower(text), 'src1', ''))) / 4)
    + 5 * ((length(lower(source)) - length(replace(lower(source), 'the', ''))) / 3) + least(10, (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3) AS BIGINT) AS score FROM documents"""
)
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", evals.document_score(F.col("source"), F.col("text"), ["src1", "the"]).cast("long").alias("score"))


@query(
    """SELECT lang AS skill, count(*) AS n, round(avg(greatest(1, least(5, quality * 4 + 1))), 6) AS wiki, round(avg(greatest(1, least(5, toxic * 6))), 6) AS baseline,
    round(avg(greatest(1, least(5, quality * 4 + 1))) - avg(greatest(1, least(5, toxic * 6))), 6) AS delta FROM labels JOIN documents USING (doc_id) WHERE source <> 'src3' GROUP BY GROUPING SETS ((lang), ())"""
)
def skill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("skill"), (F.col("source") == "src3").alias("failed"))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    return evals.summary(rows.select("skill", (F.col("quality") * 4 + 1).alias("wiki"), (F.col("toxic") * 6).alias("baseline"), "failed"))


@query(
    """SELECT conv_id, turn, CAST(floor(length(text) * 0.15) AS BIGINT) AS response, CAST(floor(length(text) * 0.5) AS BIGINT) AS pages,
    CAST(least(floor(length(text) * 0.5), greatest(5000, floor(floor(length(text) * 0.5) * 0.3))) AS BIGINT) AS page FROM conversations"""
)
def context_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.context_budget(F.length("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", b["response"].alias("response"), b["pages"].alias("pages"), b["page"].cast("long").alias("page"))


@query(
    """SELECT doc_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 199) || '…' ELSE s END AS summary FROM (
    SELECT doc_id, trim(coalesce(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(l, '^\\s*(#|\\||---|```)'))[1], '')) AS s FROM documents)"""
)
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.entity_summary(F.col("text"), F.lit(None).cast("string")).alias("summary"))


@query(
    f"""WITH p AS (SELECT 'wiki/' || folder || '/' || slug || '.md' AS path, kind, p_size FROM {_MADE})
    SELECT path, 'hard' AS severity, 'type-directory-mismatch' AS code, 'type' AS field FROM p WHERE kind = 'source'
    UNION ALL SELECT path, 'soft', 'invalid-enum', 'created' FROM p WHERE kind = 'concept' AND 1 + p_size % 28 <> 2"""
)
def ontology_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against the built-in types, of which concepts may be of one day only."""
    known = ontology.given(spark, {"concept": {"created": ["2024-01-02"]}})
    return ontology.violations(made_pages(spark, sf_dir).select("path", "content"), known, "2026-01-01")


@query(
    f"""WITH n AS (SELECT kind AS type, folder, count(*) AS n FROM {_MADE} WHERE kind <> 'entity' GROUP BY ALL)
    SELECT type, arg_min(folder, -n * 1000 + CASE folder WHEN 'concepts' THEN 0 ELSE 1 END) AS folder, CAST(sum(n) AS BIGINT) AS n_pages, max(n) AS n_there, 'created,related,title,type' AS required FROM n GROUP BY type"""
)
def induced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that pages have beyond entities, with their folders, support and common fields."""
    known = ontology.given(spark).where("type = 'entity'")
    made = ontology.induced(made_pages(spark, sf_dir).select("path", "content"), known)
    return made.select("type", "folder", "n_pages", "n_there", F.array_join("required", ",").alias("required"))
