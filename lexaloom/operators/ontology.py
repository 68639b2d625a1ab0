"""Page types as a table: induced from pages, merged with given ones, and held against every page, with the fixes that need no judgement.

An ontology is a table (type, folder, required, enums); pages meet it by joins on
type and on folder, so it may hold as many types as a corpus has. Types that pages
use and the table does not know are induced by aggregation: the folder that most
of a type's pages lie in, and the fields that all of them have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.functions import front_matter
from lexaloom.operators.quality import DIRECTORIES, REQUIRED

SCHEMA = "type string, folder string, required array<string>, enums array<struct<field:string,allowed:array<string>>>"
#: Pages at the root of a wiki that are no content.
STRUCTURAL_PATHS = ["wiki/index.md", "wiki/log.md", "wiki/overview.md"]
_MAP = "map<string,string>"


def given(spark: SparkSession, enums: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """The built-in types as an ontology, with allowed values of fields by type."""
    rows = [(t, d, list(REQUIRED), [(f, v) for f, v in (enums or {}).get(t, {}).items()]) for t, d in DIRECTORIES.items()]
    return spark.createDataFrame(rows, SCHEMA)


def page_facts(pages: DataFrame) -> DataFrame:
    """path, content, folder (of pages in one), type, fields (a map of texts; null if there is no readable block) and body of pages (path, content)."""
    m = front_matter.front_matter(F.coalesce(F.col("content"), F.lit("")))
    read = pages.select("path", "content", m.alias("m")).select("path", "content", F.from_json(F.to_json("m.fields"), _MAP).alias("fields"), "m.body")
    # a list field counts as its items, joined
    listed = lambda k, v: F.when(v.startswith("["), F.coalesce(F.array_join(F.from_json(v, "array<string>"), ","), v)).otherwise(v)
    read = read.withColumn("fields", F.transform_values("fields", lambda k, v: F.trim(listed(k, v))))
    folder = F.regexp_extract("path", r"^wiki/([^/]+)/", 1)
    return read.select("path", "content", F.nullif(folder, F.lit("")).alias("folder"), F.nullif(F.lower(F.col("fields")["type"]), F.lit("")).alias("type"), "fields", "body")


def induced(pages: DataFrame, ontology: DataFrame) -> DataFrame:
    """type, folder, n_pages, n_there (pages in that folder), required and enums of each type that pages have and the ontology does not.

    The folder is the one with most pages of the type, ties to the smaller name;
    required are the fields that every page of the type has, not empty.
    """
    facts = page_facts(pages).where(F.col("type").isNotNull()).join(ontology.select("type"), "type", "left_anti")
    folders = facts.groupBy("type", "folder").agg(F.count(F.lit(1)).alias("n"))
    by_type = folders.groupBy("type").agg(F.sum("n").alias("n_pages"))
    best = folders.where("folder IS NOT NULL").groupBy("type").agg(F.max("n").alias("n_there")).join(folders, "type").where("n = n_there").groupBy("type", "n_there").agg(F.min("folder").alias("folder"))
    fields = facts.select("type", F.explode("fields").alias("field", "value")).where("value <> ''").groupBy("type", "field").agg(F.count(F.lit(1)).alias("n"))
    whole = by_type.join(fields, "type").where("n = n_pages").groupBy("type").agg(F.array_sort(F.collect_list("field")).alias("required"))
    out = by_type.join(best, "type", "left").join(whole, "type", "left")
    none = F.array().cast("array<struct<field:string,allowed:array<string>>>")
    return out.select("type", F.coalesce("folder", F.lit("")).alias("folder"), "n_pages", F.coalesce("n_there", F.lit(0)).alias("n_there"), F.coalesce("required", F.array().cast("array<string>")).alias("required"), none.alias("enums"))


def bootstrapped(pages: DataFrame, ontology: DataFrame) -> DataFrame:
    """The ontology with the types that pages add to it; these require what all pages do, not more."""
    more = induced(pages, ontology)
    return ontology.unionByName(more.select("type", "folder", F.array_intersect("required", F.array(*map(F.lit, REQUIRED))).alias("required"), "enums"))


def _stamped(facts: DataFrame, ontology: DataFrame, today: str) -> DataFrame:
    """facts with ``stamped``: fields with created and updated, and the type of the folder where there is none."""
    of_folder = ontology.where("folder <> ''").groupBy("folder").agg(F.min("type").alias("folder_type"))
    both = facts.join(of_folder, "folder", "left")
    missing = lambda f: F.coalesce(F.col("fields")[f], F.lit("")) == ""
    entry = lambda f, v: F.when(missing(f) & v.isNotNull(), F.struct(F.lit(f).alias("key"), v.alias("value")))
    new = F.array_compact(F.array(entry("type", F.col("folder_type")), entry("created", F.lit(today)), entry("updated", F.lit(today))))
    kept = F.filter(F.map_entries("fields"), lambda e: ~F.exists(new, lambda x: x["key"] == e["key"]))
    both = both.withColumn("added", F.when(F.col("fields").isNotNull(), F.transform(new, lambda x: x["key"])).otherwise(F.array().cast("array<string>")))
    both = both.withColumn("stamped", F.map_from_entries(F.concat(kept, new)))
    return both.withColumn("type", F.nullif(F.lower(F.col("stamped")["type"]), F.lit("")))


def violations(pages: DataFrame, ontology: DataFrame, today: str, permissive: bool = False) -> DataFrame:
    """path, severity (hard or soft), code and field of what is wrong with pages (path, content) after the fixes that need no judgement.

    Codes: missing-frontmatter, unknown-type, missing-required, type-directory-mismatch
    and, soft, invalid-enum. A page without fields or of unknown type is not judged
    further. permissive makes every finding soft. Structural pages and files outside of the wiki have none.
    """
    content = pages.where(F.col("path").startswith("wiki/") & F.col("path").endswith(".md") & ~F.col("path").isin(STRUCTURAL_PATHS))
    facts = _stamped(page_facts(content), ontology, today)
    both = facts.join(ontology.withColumnsRenamed({"folder": "expected"}).withColumn("known", F.lit(True)), "type", "left")
    value = lambda f: F.coalesce(F.element_at(F.col("stamped"), f), F.lit(""))
    row = lambda severity, code, field: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), field.cast("string").alias("field"))
    nothing = F.array().cast("array<struct<severity:string,code:string,field:string>>")
    required = F.transform(F.filter("required", lambda f: value(f) == ""), lambda f: row("hard", "missing-required", f))
    wrong = F.filter("enums", lambda e: (value(e["field"]) != "") & ~F.array_contains(e["allowed"], value(e["field"])))
    place = F.when((F.col("expected") != "") & F.col("folder").isNotNull() & (F.col("folder") != F.col("expected")), F.array(row("hard", "type-directory-mismatch", F.lit("type")))).otherwise(nothing)
    found = (
        F.when(F.col("fields").isNull(), F.array(row("hard", "missing-frontmatter", F.lit(None))))
        .when(F.col("known").isNull(), F.array(row("hard", "unknown-type", F.lit("type"))))
        .otherwise(F.concat(required, place, F.transform(wrong, lambda e: row("soft", "invalid-enum", e["field"]))))
    )
    out = both.select("path", F.explode(found).alias("v"))
    return out.select("path", (F.lit("soft") if permissive else F.col("v.severity")).alias("severity"), "v.code", "v.field")


def fixes(pages: DataFrame, ontology: DataFrame, today: str) -> DataFrame:
    """path, content and added (names of fields) of pages that lack a date or a type that their folder gives: the page as it is written with them."""
    done = _stamped(page_facts(pages), ontology, today).where(F.size("added") > 0)
    m = front_matter.front_matter(F.coalesce(F.col("content"), F.lit("")))
    lines = F.transform("added", lambda f: F.concat(f, F.lit(": "), F.element_at(F.col("stamped"), f)))
    block = F.regexp_extract(m["block"], r"(?s)\A---\s*\r?\n(.*?)\r?\n---\s*\z", 1)
    emptied = F.aggregate("added", block, lambda b, f: F.regexp_replace(b, F.concat(F.lit("(?m)^"), f, F.lit(r":[ \t]*(?:''|\"\"|~|null)?[ \t]*(?:\r?\n|\z)")), F.lit("")))
    text = F.concat(F.lit("---\n"), F.regexp_replace(emptied, r"\s+\z", ""), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), F.regexp_replace(F.col("body"), r"\A\s*\n", ""))
    return done.select("path", text.alias("content"), "added")


def reviews(found: DataFrame) -> DataFrame:
    """type, title, n_findings and description of one review for each page with violations."""
    said = F.concat_ws(" ", "code", "field")
    each = found.groupBy("path").agg(F.count(F.lit(1)).alias("n_findings"), F.array_join(F.array_sort(F.collect_set(said)), "; ").alias("description"))
    key = F.regexp_replace(F.regexp_replace("path", "^wiki/", ""), r"\.md$", "")
    return each.select(F.lit("schema-violation").alias("type"), F.concat(F.lit("Schema: "), key).alias("title"), "path", "n_findings", "description")

