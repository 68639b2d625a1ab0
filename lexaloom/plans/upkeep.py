"""Queries of page rewriting, merges, citations, queues and graph extracts over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.functions import front_matter, model_output, repairs
from lexaloom.functions import rewriting as R
from lexaloom.operators import upkeep
from lexaloom.session import table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as pages part-K that link to part K-1 by identifier, to part K/2 by title and to a page that is not there."""
    p = table(spark, sf_dir, "part", spread=4)
    k, half = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 2).cast("string")
    near = lambda n: (F.col("p_partkey") + n).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ["entity", "concept", "source"])), (1 + F.col("p_partkey") % 3).cast("int"))
    content = F.concat(
        F.lit("---\ntitle: Part "), k, F.lit("\ntype: "), kind, F.lit("\nrelated: [Part "), half, F.lit(', "part-'), near(1), F.lit('", PART-'), half,
        F.lit("]\nsources: [s"), (F.col("p_partkey") % 50).cast("string"), F.lit(".pdf]\n---\n# Part "), k,
        F.lit("\n[[part-"), near(-1), F.lit("|before]], [[Part "), half, F.lit("]], [[gone-"), (F.col("p_partkey") % 3).cast("string"), F.lit("]]\n"),
    )
    return p.select(F.concat(F.lit("wiki/entities/part-"), k, F.lit(".md")).alias("path"), content.alias("content"))


def _content(related: str, sources: str = "'[s' || (k % 50) || '.pdf]'", before: str = "k - 1", title: str = "'Part ' || k") -> str:
    """A page's text, given SQL for its related and sources fields, its first link and its title."""
    kind = "['entity', 'concept', 'source'][CAST(1 + k % 3 AS INT)]"
    return (
        f"'---\ntitle: ' || {title} || '\ntype: ' || {kind} || '\nrelated: ' || {related} || '\nsources: ' || {sources} || '\n---\n# Part ' || k || "
        f"'\n[[part-' || ({before}) || '|before]], [[Part ' || (k // 2) || ']], [[gone-' || (k % 3) || ']]\n'"
    )


_RAW = "'[Part ' || (k // 2) || ', \"part-' || (k + 1) || '\", PART-' || (k // 2) || ']'"
_K = "(SELECT p_partkey AS k FROM part)"
PAGE_NODES = "(SELECT 'part-' || p_partkey AS id, ['entity', 'concept', 'source'][CAST(1 + p_partkey % 3 AS INT)] AS type FROM part)"
PAGE_EDGES = f"(SELECT 'part-' || k AS src, 'part-' || (k - 1) AS dst FROM {_K} WHERE k - 1 IN (SELECT p_partkey FROM part) UNION SELECT 'part-' || k, 'part-' || (k // 2) FROM {_K} WHERE k // 2 <> k AND k // 2 IN (SELECT p_partkey FROM part))"
PAGE_RELATED = f"(SELECT 'part-' || k AS src, 'part-' || (k + 1) AS dst FROM {_K} WHERE k + 1 IN (SELECT p_partkey FROM part) UNION SELECT 'part-' || k, 'part-' || (k // 2) FROM {_K} WHERE k // 2 <> k AND k // 2 IN (SELECT p_partkey FROM part))"
PAGE_SOURCES = "(SELECT 'part-' || p_partkey AS id, p_partkey % 50 AS s FROM part)"


def _listed(*items: str) -> str:
    return "'[' || " + " || ', ' || ".join(f"'\"' || {x} || '\"'" for x in items) + " || ']'"


@query(f"SELECT 'wiki/entities/part-' || k || '.md' AS path, {_content(_listed(chr(39) + 'part-' + chr(39) + ' || (k // 2)', chr(39) + 'part-' + chr(39) + ' || (k + 1)'))} AS content FROM {_K}")
def canonical_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.canonical_related(linked_pages(spark, sf_dir))


_MERGED = _content(
    _listed("'Part ' || (k // 2)", "'PART-' || (k // 2)", "'part-' || (k + 2)"), _listed("'s' || (k % 50) || '.pdf'", "'s' || ((k + 1) % 50) || '.pdf'")
)


@query(
    f"""SELECT 'wiki/entities/part-' || k || '.md' AS path, CASE WHEN k % 10 = 8 AND k + 1 IN (SELECT p_partkey FROM part) THEN {_MERGED}
    WHEN k % 10 = 0 AND k > 0 THEN {_content(_RAW, before="k - 2")} ELSE {_content(_RAW)} END AS content FROM {_K} WHERE k % 10 <> 9"""
)
def merge_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tenth page is merged into the one before it."""
    key = table(spark, sf_dir, "part").where("p_partkey % 10 = 9").select(F.col("p_partkey").alias("k"))
    name = lambda k: F.concat(F.lit("part-"), k.cast("string"))
    return upkeep.execute_merge(linked_pages(spark, sf_dir), key.select(name(F.col("k")).alias("old"), name(F.col("k") - 1).alias("new")))


@query(
    f"""SELECT 'wiki/entities/part-' || k || '.md' AS path, replace({_content(_RAW, _listed("'s' || (k % 50) || '.pdf'", "'S7.pdf'"), title="'cost $1 \\'")}, chr(10) || '---' || chr(10) || '# Part', chr(10) || 'updated: 2024-05-01' || chr(10) || '---' || chr(10) || '# Part') AS content
    FROM {_K} WHERE k % 50 <> 7 UNION ALL SELECT 'wiki/entities/part-' || k || '.md', replace({_content(_RAW, title="'cost $1 \\'")}, chr(10) || '---' || chr(10) || '# Part', chr(10) || 'updated: 2024-05-01' || chr(10) || '---' || chr(10) || '# Part') FROM {_K} WHERE k % 50 = 7"""
)
def front_matter_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title is replaced, a date added, and a source made sure of."""
    titled = R.with_scalar(R.with_scalar(F.col("content"), "title", F.lit("cost $1 \\")), "updated", F.lit("2024-05-01"))
    return linked_pages(spark, sf_dir).select("path", titled.alias("content")).select("path", R.with_source(F.col("content"), F.lit(" S7.pdf")).alias("content"))


@query(
    """WITH n AS (SELECT o_orderkey AS id, unnest(CASE o_orderkey % 4 WHEN 0 THEN [9, 1] WHEN 1 THEN [2, 7] WHEN 2 THEN [3] ELSE [] END) AS position FROM orders),
    p AS (SELECT DISTINCT id, CASE WHEN id % 4 = 2 THEN 'note' ELSE 'number' END AS via, position, 'p' || l_partkey AS page FROM n JOIN lineitem ON l_orderkey = id AND l_linenumber = position)
    SELECT * FROM p UNION ALL SELECT o_orderkey, 'link', NULL, unnest(['a', 'c']) FROM orders WHERE o_orderkey % 4 = 3 OR (o_orderkey % 4 = 1 AND o_orderkey NOT IN (SELECT id FROM p))"""
)
def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to orders cite lines of theirs: by a note, numbers or links."""
    answers = ["x <!-- cited: 9, z --> see [1]", "see [2], [2] and [7], or [[a|b]] and [[c]]", "x <!-- cited: 3 -->", "[[a|b]] and [[c]], [[a]]"]
    text = F.element_at(F.array(*map(F.lit, answers)), (1 + F.col("o_orderkey") % 4).cast("int"))
    context = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("page"))
    return upkeep.cited_pages(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), context)


@query(
    """SELECT url, query, rank FROM (SELECT 'p' || l_partkey AS url, l_orderkey AS query, l_linenumber AS rank, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n
    FROM lineitem WHERE l_linenumber <= 5) WHERE n = 1"""
)
def first_seen_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return upkeep.first_seen(line.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank")))


@query(
    """SELECT key, slug, place FROM (SELECT key, slug, row_number() OVER (PARTITION BY key ORDER BY tier, rank, slug) AS place FROM (
    SELECT l_suppkey AS key, l_partkey AS slug, l_linenumber % 3 AS tier, l_orderkey AS rank, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_linenumber % 3, l_orderkey) AS n FROM lineitem) WHERE n = 1) WHERE place <= 30"""
)
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return upkeep.candidates(line.select(F.col("l_suppkey").alias("key"), (F.col("l_linenumber") % 3).alias("tier"), F.col("l_orderkey").alias("rank"), F.col("l_partkey").alias("slug")))


@query("SELECT 'wiki/' || source || '/doc-' || doc_id || '.md' AS path FROM documents WHERE source = 'src3' OR doc_id % 10 = 0")
def known_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder and each tenth page have gone."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("wiki/"), "source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    folder = d.where("source = 'src3'").select(F.concat(F.lit("wiki/"), "source").alias("path")).distinct()
    return upkeep.known_paths(folder.unionByName(d.where("doc_id % 10 = 0").select(path.alias("path"))), d.select(path.alias("path")))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    n = (F.col("o_orderkey") % 4).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task"), status.alias("status"), F.when(status == "failed", "late").alias("error"), n.alias("retry_count"), (n == 3).alias("needs_rerun")
    )


@query(
    """SELECT o_orderkey AS task, 'pending' AS status, CAST(NULL AS VARCHAR) AS error, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_orderkey % 4 AS INT) END AS retry_count,
    o_orderstatus <> 'F' AND o_orderkey % 4 = 3 AS needs_rerun FROM orders"""
)
def queue_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.retry(upkeep.recover(_queue(spark, sf_dir)))


@query(
    """SELECT 'page' AS what, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'chunk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)"""
)
def cancelled_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of each fifth customer are cancelled; orders are their pages and lines the chunks of these."""
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    written = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.concat(F.lit("wiki/"), name("o_orderkey"), F.lit(".md")).alias("path"))
    chunks = table(spark, sf_dir, "lineitem").select(name("l_orderkey").alias("page_id"))
    pages, left = upkeep.cancel(written.where("task % 5 = 0").select("task"), written, written.select("path"), chunks)
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(pages, "page").unionByName(count(left, "chunk"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.floor(F.col("l_partkey") / 3).cast("long").alias("dst")).distinct()


@query(
    """WITH n AS (SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'red') OR contains(CAST(p_partkey AS VARCHAR), 'red')) AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 500)
    SELECT DISTINCT l_partkey AS src, l_partkey // 3 AS dst FROM lineitem WHERE l_partkey IN (SELECT id FROM n) AND l_partkey // 3 IN (SELECT id FROM n)"""
)
def graph_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.graph_slice(_nodes(spark, sf_dir), _edges(spark, sf_dir), "RED", "economy", 500)


@query(
    """WITH w AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS weight FROM lineitem GROUP BY 1, 2)
    SELECT a, b, weight, round(0.5::DOUBLE + 3.5::DOUBLE * weight / (SELECT greatest(max(weight), 1) FROM w), 6) AS size FROM w"""
)
def display_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return upkeep.display_weights(w).withColumn("size", F.round("size", 6))


@query(
    """SELECT kind, count(*) AS n, CAST(sum(('0x' || substr(md5(key), 1, 15))::BIGINT) AS VARCHAR) AS mark FROM (SELECT 'node' AS kind, CAST(p_partkey AS VARCHAR) AS key FROM part
    UNION ALL SELECT 'edge', src || '->' || dst FROM (SELECT DISTINCT l_partkey AS src, l_partkey // 3 AS dst FROM lineitem)) GROUP BY kind"""
)
def graph_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.topology(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(
    """SELECT DISTINCT p_brand || ',' || p_type AS slugs FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part WHERE p_size = 1)"""
)
def unsuppressed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type of parts as groups; those of parts of size 1 are known to be different things."""
    p = table(spark, sf_dir, "part")
    known = p.where("p_size = 1").select(F.array(F.upper("p_type"), F.lower("p_brand")).alias("slugs"))
    return upkeep.unsuppressed(p.select(F.array("p_brand", "p_type").alias("slugs")), known).select(F.array_join("slugs", ",").alias("slugs"))


@query(
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(list_reduce(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '##') OR contains(lower(l), 'the') OR contains(lower(l), 'ing')),
    lambda s, l: CASE WHEN length(s) + length(l) + 1 <= 300 THEN s || chr(10) || l ELSE s END, ''), 2) || chr(10) || chr(10) || '[...index trimmed to relevant entries...]' ELSE text END AS kept FROM documents"""
)
def index_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.trimmed_index(F.col("text"), ["the", "ing"], 300).alias("kept"))


@query(
    """SELECT conv_id, turn, greatest(10000, CASE WHEN n > 0 THEN n ELSE 200000 END - 28000) AS analysis, greatest(10000, CASE WHEN n > 0 THEN n ELSE 200000 END - 44000) AS generation
    FROM (SELECT conv_id, turn, (length(text) - 100) * 500 AS n FROM conversations)"""
)
def chunk_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", R.chunk_budgets((F.length("text").cast("long") - 100) * 500).alias("b")).select("conv_id", "turn", "b.*")


@query(
    """SELECT p_partkey, 'ch' || lpad(CAST(p_partkey + 1 AS VARCHAR), CAST(greatest(2, length(CAST(p_partkey + 1 AS VARCHAR))) AS INT), '0') || '-' || replace(p_name, ' ', '-') AS chapter,
    '- [[' || replace(p_name, ' ', '-') || '|' || p_name || ']] — ' || CASE WHEN p_size % 2 = 0 THEN '(no description)' ELSE p_brand END AS entry FROM part"""
)
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter names and index lines of parts."""
    name = F.col("p_name")
    about: Column = F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand"))
    entry = R.index_entry(F.replace(name, F.lit(" "), F.lit("-")), about, name)
    return table(spark, sf_dir, "part").select("p_partkey", R.chapter_slug(F.col("p_partkey"), F.concat(name, F.lit("?!"))).alias("chapter"), entry.alias("entry"))


@query("SELECT p_partkey, unnest(['orphan', 'gap']) AS type, unnest(['warning', 'info']) AS severity, unnest([p_name, p_brand]) AS title, unnest(['one' || chr(10) || 'two', '']) AS body FROM part")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a model wrote on parts."""
    text = F.concat(F.lit("x\n---LINT: Orphan | warning | "), "p_name", F.lit("---\none\ntwo\n---END LINT---\ny\n---LINT: gap|INFO|"), "p_brand", F.lit("---\n---END LINT---\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(R.lint_blocks(text)).alias("b")).select("p_partkey", "b.*")


@query(
    """SELECT doc_id, 'doc-' || doc_id || ',{' || source || '}' AS slugs, CASE WHEN doc_id % 3 = 0 THEN '{' || source || '}' ELSE 'doc-' || doc_id END AS canonical_slug, 'as "' || lang || '" } {' AS reason,
    CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, doc_id % 5 = 0 AS contradictory FROM documents WHERE doc_id % 7 <> 0"""
)
def judged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups read from answers made of documents: in fences and prose, with braces in strings, values of other types and, of every seventh, no end."""
    d = table(spark, sf_dir, "documents")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r'\\$1'), F.lit('"'))
    own, other = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.concat(F.lit("{"), "source", F.lit("}"))
    group = F.concat(
        F.lit('{"slugs": ['), quoted(own), F.lit(", 7, "), quoted(other), F.lit('], "canonicalSlug": '), F.when(F.col("doc_id") % 3 == 0, quoted(other)).otherwise('"gone"'),
        F.lit(', "reason": '), quoted(F.concat(F.lit('as "'), "lang", F.lit('" } {'))), F.lit(', "confidence": '), F.when(F.col("doc_id") % 2 == 0, '"high"').otherwise("0.4"),
        F.lit(', "contradictory": '), F.when(F.col("doc_id") % 5 == 0, "true").otherwise('"no"'), F.lit("}"),
    )
    end = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit(", {\"slugs\": []}]}\n```\nThat is all } for "), F.substring("text", 1, 40)))
    answer = F.concat(F.lit('Here you go:\n```json\n{"groups": ['), group, end)
    found = d.select("doc_id", F.explode(model_output.duplicate_groups(answer)).alias("g"))
    return found.select("doc_id", F.array_join("g.slugs", ",").alias("slugs"), "g.canonical_slug", "g.reason", "g.confidence", "g.contradictory")


@query(
    """SELECT doc_id, 'Doc: ' || doc_id AS title, '[[doc-' || (doc_id - 1) || ']],[[doc-' || (doc_id + 1) || ']]' AS related, 'true' AS draft, sha256(text) AS body_sha256,
    doc_id % 4 <> 3 AS readable FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 3
    UNION ALL SELECT doc_id, NULL, '', NULL, sha256(text), false FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 3"""
)
def repaired_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields and bodies of documents whose blocks stand at the top, behind a stray line or in a code fence, with unquoted link lists; every fourth block is no YAML."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    k = F.col("doc_id")
    link = lambda n: F.concat(F.lit("[[doc-"), (k + n).cast("string"), F.lit("]]"))
    block = F.concat(
        F.lit('---\ntitle: "Doc: '), k.cast("string"), F.lit('"\nrelated: '), link(-1), F.lit(", "), link(1), F.lit("\ndraft: true\n"), F.when(k % 4 == 3, "tags: [open\n").otherwise(""), F.lit("---\n")
    )
    page = F.when(k % 4 == 1, F.concat(F.lit("```yaml\n"), block, F.lit("```\n"), "text")).when(k % 4 == 2, F.concat(F.lit("frontmatter:\n"), block, "text")).otherwise(F.concat(block, "text"))
    made = d.select("doc_id", front_matter.front_matter(page).alias("m"))
    related = F.coalesce(F.try_variant_get("m.fields", "$.related", "array<string>"), F.array().cast("array<string>"))
    return made.select(
        "doc_id", F.try_variant_get("m.fields", "$.title", "string").alias("title"), F.array_join(related, ",").alias("related"),
        F.try_variant_get("m.fields", "$.draft", "string").alias("draft"), F.sha2("m.body", 256).alias("body_sha256"), F.col("m.fields").isNotNull().alias("readable"),
    )


@query(
    """WITH d AS (SELECT doc_id, doc_id % 6 AS k, coalesce(text, '') AS t, '---' || chr(10) || 'type: entity' || chr(10) || 'related: ["[[doc-' || (doc_id - 1) || ']]", "[[doc-' || (doc_id + 1) || ']]"]' || chr(10) || '---' || chr(10) AS block FROM documents)
    SELECT doc_id, sha256(CASE k WHEN 4 THEN block || chr(10) || ltrim(t, chr(10) || ' ') ELSE block || t END) AS content_sha256,
    ['field-links', 'yaml-fence,field-links', 'outer-fence,field-links', 'key-prefix,field-links', 'inline-fields,field-links', 'second-end'][k + 1] AS rules, true AS settled FROM d"""
)
def page_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with damaged blocks, mended: the new text's SHA-256, the rules that took part, and that mending it again changes nothing."""
    d = table(spark, sf_dir, "documents", spread=4).select("doc_id", (F.col("doc_id") % 6).alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    link = lambda n, mark: F.concat(F.lit(f"{mark}[[doc-"), (F.col("doc_id") + n).cast("string"), F.lit(f"]]{mark}"))
    fields = F.concat(F.lit("type: entity\nrelated: "), link(-1, ""), F.lit(", "), link(1, ""))
    good = F.concat(F.lit("---\ntype: entity\nrelated: ["), link(-1, '"'), F.lit(", "), link(1, '"'), F.lit("]\n---\n"))
    block = F.concat(F.lit("---\n"), fields, F.lit("\n---\n"), F.col("t"))
    page = (
        F.when(F.col("k") == 0, block).when(F.col("k") == 1, F.regexp_replace(block, r"\A---", "---yaml")).when(F.col("k") == 2, F.concat(F.lit("```md\n"), block, F.lit("\n```\n")))
        .when(F.col("k") == 3, F.concat(F.lit("frontmatter:\n"), block)).when(F.col("k") == 4, F.concat(fields, F.lit("\n\n"), F.ltrim("t"))).otherwise(F.concat(good, F.lit("---\n"), F.col("t")))
    )
    made = d.select("doc_id", repairs.repair_steps(page).alias("m")).select("doc_id", "m.text", "m.rules", "m.settled")
    return made.select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.array_join("rules", ",").alias("rules"), (F.col("settled") | (repairs.repaired(F.col("text")) == F.col("text"))).alias("settled"))
