"""Links, logs, questions, blocks, paths, reviews, listings and vectors."""

from pyspark.sql import functions as F

from lexaloom.functions import markup as M
from lexaloom.functions import paths as P
from lexaloom.operators import evals, listing, matching, reviews, vectors
from lexaloom.plans import maintenance
from lexaloom.plans import upkeep as upkeep_plans


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()[0]


def test_links(spark):
    text = "a [[x|X y]] b [[z]]\n- [[Gone Page|g]] line\n- [[kept]]"
    assert one(spark, M.unwrapped_links, text) == "a X y b z\n- g line\n- kept"
    assert one(spark, M.markdown_links, "[[x|X]] [[z]]") == "[X](x.md) [z](z.md)"
    keys = F.array(F.lit("gonepage"), F.lit("z"))
    assert one(spark, lambda c: M.without_listing(c, keys), text) == "a [[x|X y]] b [[z]]\n- [[kept]]"
    assert one(spark, lambda c: M.without_links(c, keys), "a [[z]] [[gone-page|G]] [[x]]") == "a z G [[x]]"


def test_logs_and_questions(spark):
    for line in ("## [2024-01-02] Ingest | a b", "## 2024-01-02 ingest: a b", "- 2024-01-02: ingest a b"):
        assert tuple(one(spark, M.log_entry, line)) == ("2024-01-02", "ingest", "a b")
    assert one(spark, M.log_entry, "words") is None
    assert one(spark, M.is_greeting, "Hello there!") and not one(spark, M.is_greeting, "hello what is spark")
    assert one(spark, M.sub_queries, "Compare Spark and Flink please") == ["Spark", "Flink"]
    assert one(spark, M.sub_queries, "(i) what is a (ii) what is b") == ["what is a", "what is b"]
    assert one(spark, M.sub_queries, "what is a") == ["what is a"]


def test_blocks(spark):
    text = "x\n---FILE: wiki/a.md ---\nline 1\nline 2\n--- END FILE ---\n---REVIEW: duplicate | Two pages---\nbody\n---END REVIEW---\n<entities>[{\"name\":\"A\",\"type\":\"entity\"},{\"name\":\"\"}]</entities><entities>no</entities>"
    assert [tuple(r) for r in one(spark, M.file_blocks, text)] == [("wiki/a.md", "line 1\nline 2")]
    assert [tuple(r) for r in one(spark, M.review_blocks, text)] == [("duplicate", "Two pages", "body")]
    assert [tuple(r) for r in one(spark, M.entity_rows, text)] == [("A", "entity", None)]
    assert one(spark, lambda c: M.whole_sources(F.split(c, ";")), "a b.pdf;b.pdf;c") == ["a b.pdf", "c"]


def test_paths(spark):
    good, bad = ["a/b.md", "wiki/ü.txt"], ["/a", "a/../b", "con", "a/NUL.txt", "x?", "a:b", ""]
    assert all(one(spark, P.is_safe, p) for p in good) and not any(one(spark, P.is_safe, p) for p in bad)
    assert [one(spark, P.category, p) for p in ("a.PDF", "b.py", "c", "d.tar.gz")] == ["document", "code", "other", "other"]
    assert one(spark, P.is_ingestable, "raw/a.pdf") and not one(spark, P.is_ingestable, "raw/.cache/a.pdf")
    assert one(spark, P.folder_context, "a\\b//c.md") == "a > b" and one(spark, P.safe_segment, "a/b?. ") == "a-b-"
    assert one(spark, lambda c: P.matches_glob(c, "*.tmp"), "x/Y.TMP") and one(spark, P.hostname, "https://u@www.Ex.org:8/p") == "ex.org"
    assert one(spark, P.is_newer, "v1.10.0", "1.9.3") and not one(spark, P.is_newer, "1.2", "1.2")


def test_reviews_and_listings(spark):
    rows = [("r1", "dup", "Duplicate page: A", "old", ["a"], 1, False), ("r2", "dup", "a", "new", ["b", "a"], 2, False), ("r3", "dup", "A", "done", ["c"], 3, True)]
    df = spark.createDataFrame(rows, "id string, type string, title string, description string, affected array<string>, created_at int, resolved boolean")
    got = {r["id"]: (r["description"], r["affected"]) for r in reviews.merge(df).collect()}
    assert got == {"r1": ("new", ["a", "b"]), "r3": ("done", ["c"])}
    pages = spark.createDataFrame([("wiki/concepts/a.md", "# A\n[[b]]"), ("wiki/entities/a.md", "- [[b|B]]\nend"), ("wiki/concepts/b.md", "b"), ("wiki/index.md", "- [[a]]")], "path string, content string")
    assert [r[0] for r in listing.type_collisions(pages).collect()] == ["a"]
    assert {r["path"] for r in listing.unlisted(pages, pages.where("path = 'wiki/index.md'")).collect()} == {"wiki/concepts/b.md"}
    left = dict(listing.delete_pages(pages, spark.createDataFrame([("b", "B")], "slug string, title string")).collect())
    assert left == {"wiki/concepts/a.md": "# A\nb", "wiki/entities/a.md": "end", "wiki/index.md": "- [[a]]"}
    cover = dict(listing.coverage(spark.createDataFrame([("A",), ("a",), ("Zed",)], "name string"), pages).collect())
    assert cover == {"A": True, "Zed": False}
    hits = spark.createDataFrame([("q", 1, "About Spark", "x"), ("q", 4, "Flink", "x")], "query string, rank int, title string, snippet string")
    assert [r["name"] for r in reviews.uncovered(spark.createDataFrame([("spark", "q"), ("flink", "q")], "name string, query string"), hits).collect()] == ["flink"]


def test_vectors_and_scores(spark):
    store = spark.createDataFrame([(k, k % 2, 0, [1.0, 2.0]) for k in range(5)], "chunk_id int, page_id int, chunk_index int, vector array<double>")
    new = spark.createDataFrame([(10, 0, 0, [1.0, 1.0]), (11, 0, 1, [float("nan"), 1.0])], store.schema)
    assert sorted(r["chunk_id"] for r in vectors.upsert_chunks(store, new).collect()) == [1, 3, 10]
    assert vectors.upsert_chunks(store, new.limit(0)).count() == 5 and vectors.delete_pages(store, new).count() == 2
    assert tuple(vectors.sizes(store).first()) == (5, 2, 1)
    assert one(spark, lambda a, b, c: vectors.embedding_input(a, b, c), "T", " ", "x") == "T\n\nx"
    assert one(spark, lambda a, b: evals.choice_score(a, b), " b", "B") == 5.0
    rows = spark.createDataFrame([("s", 9.0, 1.0, False), ("s", 3.0, 3.0, False), ("t", 1.0, 5.0, True)], "skill string, wiki double, baseline double, failed boolean")
    assert {r["skill"]: (r["n"], r["delta"]) for r in evals.summary(rows).collect()} == {"s": (2, 2.0), None: (2, 2.0)}


def test_containing(spark):
    texts = [(1, "xa b c d ey"), (2, "a b c d"), (3, "zz"), (4, ""), (5, None), (6, "q a  b r"), (7, "a b c d e a b c d e")]
    parts = [(1, "a b c d e"), (2, "z"), (3, "b c"), (4, "a  b"), (5, ""), (6, "b c d"), (7, None), (8, "nope at all")]
    got = matching.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(parts, "key int, part string"))
    want = {(i, k) for i, t in texts for k, p in parts if t and p and p in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_made_pages_are_dealt_out(spark, tmp_path):
    """A small table of parts is one row group, read by one task: the work on its pages is not left to that task."""
    spark.range(2000).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for pages in (maintenance.made_pages(spark, str(tmp_path)), upkeep_plans.linked_pages(spark, str(tmp_path))):
        sizes = pages.rdd.glom().map(len).collect()
        assert sum(sizes) == 2000 and sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 600
