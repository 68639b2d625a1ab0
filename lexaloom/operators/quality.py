"""Page quality: structural lint, naming rules, schema validation and review sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaloom.functions import markup as M
from lexaloom.functions import text as T
from lexaloom.operators import graph

# Pages of the wiki's own structure, fields that every page needs, and value lists.
STRUCTURAL = ["index", "overview", "log", "schema", "purpose"]
REQUIRED = ["type", "title", "created"]
DIRECTORIES = {"entity": "entities", "concept": "concepts", "source": "sources", "query": "queries", "synthesis": "synthesis", "comparison": "comparisons"}
STUB_MARK = "_Stub page — batched ingest did not emit this file"


def lint(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """rule, severity, subject and detail of orphans, pages without links, and broken links.

    nodes: id; edges: src, dst, of resolved links; unresolved: id, target.
    """
    ids = nodes.select("id").distinct()
    inbound, outbound = edges.select(F.col("dst").alias("id")).distinct(), edges.select(F.col("src").alias("id")).distinct()
    row = lambda df, rule, severity, detail: df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("id").cast("string").alias("subject"), detail.cast("string").alias("detail")
    )
    none = F.lit("")
    return (
        row(ids.join(inbound, "id", "left_anti"), "orphan", "info", none)
        .unionByName(row(ids.join(outbound, "id", "left_anti"), "no-outlinks", "info", none))
        .unionByName(row(unresolved.distinct(), "broken-link", "warning", F.col("target")))
    )


def audit(pages: DataFrame) -> DataFrame:
    """rule, severity, subject and detail of naming and content defects of pages (path, content).

    Rules on one page are a narrow map with a row for each defect; rules on
    pages of a like name group by their key; a link is unresolved if the cascade
    of graph.resolve_cascade finds no page for it.
    """
    slug, content = T.file_stem(F.col("path")), F.col("content")
    p = pages.select(
        "path", "content", slug.alias("slug"), T.dedup_key(slug).alias("key"), T.scalar_field(content, "title").alias("title"),
        T.array_field(content, "related").alias("related"), T.link_targets(T.body_of(content)).alias("targets"),
    )
    one = lambda ok, rule, severity, detail: F.when(
        ok, F.array(F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))
    )
    each = lambda items, rule, severity: F.transform(
        items, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), x.alias("detail"))
    )
    named = T.page_id(F.col("title"))
    extra = F.filter(F.split("slug", "-"), lambda t: ~F.array_contains(F.split(named, "-"), t))
    wrong = (named != "") & (named != F.col("slug")) & (T.dedup_key(named) != F.col("key")) & (F.size(extra) > 0)
    opening = F.get(F.split("content", r"\r?\n"), F.lit(0))
    rules = [
        one(F.contains("content", F.lit(STUB_MARK)), "STUB-UNFILLED", "warning", F.lit("")),
        one(F.trim(F.regexp_replace(T.body_of(content), r"\s+", " ")) == "", "PAGE-EMPTY", "warning", F.lit("")),
        one((opening != "---") & (F.regexp_replace(opening, r"^\s+|\s+$", "") == "---"), "FRONTMATTER-DELIMITER-WHITESPACE", "warning", opening),
        one(F.col("slug").startswith("missing-page-"), "MISSING-PAGE-PLACEHOLDER", "warning", F.lit("")),
        one(wrong, "TITLE-SLUG-MISMATCH", "warning", F.array_join(extra, ",")),
        each(F.filter("related", lambda x: ~T.is_kebab(M.link_slug(x))), "FRONTMATTER-INCONSISTENT-LIST", "warning"),
        each(F.filter("targets", lambda x: (x == F.col("slug")) | (T.hyphenated(x) == F.col("slug"))), "LINK-SELF-REFERENCE", "info"),
        each(F.filter("targets", lambda x: x.rlike(r"[\[(]") & ~x.startswith("[[")), "LINK-MALFORMED-TEXT", "warning"),
    ]
    single = p.select("path", F.explode(F.flatten(F.array_compact(F.array(*rules)))).alias("f")).select(
        "f.rule", "f.severity", F.col("path").alias("subject"), "f.detail"
    )
    groups = p.groupBy("key").agg(F.array_sort(F.collect_set("slug")).alias("slugs"), F.count_distinct(F.lower("slug")).alias("n_low"))
    groups = groups.where(F.size("slugs") > 1)
    # slugs are sorted, so one that begins another one stands right before some slug that it begins
    starts = F.exists(F.arrays_zip(F.slice("slugs", F.lit(1), F.size("slugs") - 1).alias("a"), F.slice("slugs", F.lit(2), F.size("slugs")).alias("b")), lambda x: F.startswith(x["b"], x["a"]))
    alike = [(F.lit(True), "PUNCTUATION"), (F.col("key").rlike("[0-9]"), "VERSION-NUMBER"), (F.col("n_low") == 1, "CASE"), (starts, "TRUNCATION")]
    kinds = F.array_compact(F.array(*[F.when(ok, F.lit(f"DUP-SLUG-{name}")) for ok, name in alike]))
    named_alike = groups.select(F.explode(kinds).alias("rule"), F.lit("warning").alias("severity"), F.col("key").alias("subject"), F.array_join("slugs", ",").alias("detail"))
    return single.unionByName(named_alike).unionByName(unresolved_links(p))


def unresolved_links(pages: DataFrame) -> DataFrame:
    """rule, severity, subject and detail of each link of pages (path, slug, targets) that leads to no page.

    CASE-MISMATCH if only case or spaces are wrong (several pages match), TITLE-FORM if it is written like a title, else BROKEN-NONEXISTENT.
    """
    links = pages.select("path", F.explode("targets").alias("ref"))
    found = graph.resolve_cascade(links.select("ref"), pages.select(F.col("slug").alias("id"))).where("id IS NULL").select("ref")
    known = pages.select(F.col("slug").alias("norm")).distinct().withColumn("there", F.lit(True))
    rows = links.join(found, "ref").withColumn("norm", T.hyphenated(F.col("ref"))).join(known, "norm", "left")
    rule = F.when(F.col("there"), "LINK-CASE-MISMATCH").when(F.col("ref").rlike(r"[A-Z\s(]"), "LINK-TITLE-FORM").otherwise("LINK-BROKEN-NONEXISTENT")
    return rows.select(rule.alias("rule"), F.lit("warning").alias("severity"), F.col("path").alias("subject"), F.col("ref").alias("detail"))


def validate(pages: DataFrame, ontology: dict[str, str] | None = None) -> DataFrame:
    """path, level (hard or soft) and violation of pages (path, content) against the ontology (type: directory)."""
    known = DIRECTORIES if ontology is None else ontology
    content, path = F.col("content"), F.col("path")
    folder = F.element_at(F.split(path, "/"), 2)
    kind = F.lower(T.scalar_field(content, "type"))
    where = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    none = T.front_matter(content).isNull()
    rules = [
        ("hard", "structural-path", T.file_stem(path).isin(STRUCTURAL)),
        ("hard", "missing-frontmatter", none),
        ("hard", "unknown-type", kind.isNotNull() & F.element_at(where, kind).isNull()),
        ("hard", "type-directory-mismatch", F.element_at(where, kind).isNotNull() & (F.element_at(where, kind) != folder)),
        ("hard", "empty-body", F.trim(T.body_of(content)) == ""),
    ] + [("hard", f"missing-required:{f}", ~none & T.scalar_field(content, f).isNull()) for f in REQUIRED]
    found = [F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(name).alias("violation"))) for level, name, bad in rules]
    return pages.select("path", F.explode(F.array_compact(F.array(*found))).alias("v")).select("path", "v.level", "v.violation")


def sweep(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """id and resolved of pending reviews (id, type, title, affected).

    A missing page is resolved if a page of that identifier exists, a duplicate if any of its pages is gone.
    """
    ids = pages.select(T.file_stem(F.col("path")).alias("slug")).distinct()
    missing = reviews.where("type = 'missing-page'").withColumn("slug", T.page_id(T.review_title(F.col("title"))))
    there = missing.join(ids.withColumn("resolved", F.lit(True)), "slug", "left").select("id", F.coalesce("resolved", F.lit(False)).alias("resolved"))
    each = reviews.where("type = 'duplicate'").select("id", F.explode("affected").alias("slug"))
    seen = each.join(ids.withColumn("there", F.lit(True)), "slug", "left")
    gone = seen.groupBy("id").agg(F.bool_or(F.col("there").isNull()).alias("resolved"))
    return there.unionByName(gone)
