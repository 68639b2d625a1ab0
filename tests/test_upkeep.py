"""Page rewriting, merges, citations and queues, with the cases that the queries' tables do not hold."""

from pyspark.sql import functions as F

from lexaloom.functions import rewriting as R
from lexaloom.operators import graph, upkeep


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()[0]


def test_front_matter_fields(spark):
    put = lambda text, *items: one(spark, lambda c: R.with_array(c, "tags", F.array(*map(F.lit, items))), text)
    assert put("---\ntags: [a, b]\nx: 1\n---\nbody tags: [z]", "c$1", "d\\") == '---\ntags: ["c$1", "d\\"]\nx: 1\n---\nbody tags: [z]'
    assert put("---\ntags:\n  - a\n  - b\nx: 1\n---\n", "c") == '---\ntags: ["c"]\nx: 1\n---\n'
    assert put("---\nx: 1\n---\nb", "c") == '---\nx: 1\ntags: ["c"]\n---\nb'
    assert put("no block", "c") == "no block" and put("", "c") == "" and put(None, "c") is None
    text = lambda t: one(spark, lambda c: R.with_scalar(c, "title", F.lit("N")), t)
    assert text("---\ntitle: old\nsubtitle: s\n---\ntitle: b") == "---\ntitle: N\nsubtitle: s\n---\ntitle: b"
    assert text("---\ntitle: [a]\n---\n") == "---\ntitle: [a]\ntitle: N\n---\n"
    source = lambda t, s: one(spark, R.with_source, t, s)
    page = '---\nsources: ["A.pdf"]\n---\n'
    assert source(page, "a.PDF ") == page and source(page, " ") == page and source(page, "b") == '---\nsources: ["A.pdf", "b"]\n---\n'


def test_index_and_log(spark):
    add = lambda text: one(spark, lambda c: R.with_index_entry(c, F.lit("Concepts"), F.lit(" - [[a]] ")), text)
    assert add("# I\n## Concepts\n- [[b]]\n") == "# I\n## Concepts\n- [[a]]\n- [[b]]\n"
    assert add("# I\n\n") == "# I\n\n## Concepts\n- [[a]]\n"
    assert one(spark, R.with_log_entry, "", " e ") == "e\n" and one(spark, R.with_log_entry, "l\n\n", "e") == "l\n\ne\n"
    keys = F.array(F.lit("a"), F.lit("c"))
    assert one(spark, lambda c: R.without_mentions(c, keys), "- [[a|A]]\n- [b](x/c.md)\n- [[ab]]\na") == "- [[ab]]\na"
    assert one(spark, lambda c: R.index_entry(c, F.lit(""), F.lit("A")), "[[A]]") == "- [[A]] — (no description)"
    assert one(spark, lambda c: R.chapter_slug(F.lit(4), c), "Été & Co!") == "ch05-t-co" and one(spark, lambda c: R.chapter_slug(F.lit(99), c), "é") == "ch100-chapter"


def test_merge_rewrites_texts(spark):
    pages = [
        ("wiki/entities/a.md", "---\ntags: [x]\nrelated: [b]\nsources: [s1]\n---\nsee [[b]]"),
        ("wiki/entities/b.md", "---\ntags: [X, y]\nrelated: [a, c]\nsources: [s2]\n---\nown text"),
        ("wiki/entities/c.md", "---\nrelated: [b, a]\n---\n[[b|the b]] and [[bb]]"),
        ("wiki/entities/d.md", "no links"),
    ]
    df = spark.createDataFrame(pages, "path string, content string")
    moves = spark.createDataFrame([("b", "a")], "old string, new string")
    got = {r["path"][14:-3]: r["content"] for r in upkeep.execute_merge(df, moves).collect()}
    assert got["a"] == '---\ntags: ["x", "y"]\nrelated: ["c"]\nsources: ["s1", "s2"]\n---\nsee [[a]]'
    assert got["c"] == '---\nrelated: ["a"]\n---\n[[a|the b]] and [[bb]]' and got["d"] == "no links" and set(got) == {"a", "c", "d"}
    assert upkeep.execute_merge(df.limit(0), moves).count() == 0
    same = upkeep.execute_merge(df, moves.limit(0)).collect()
    assert {tuple(r) for r in same} == set(pages)


def test_canonical_related_and_unique_keys(spark):
    df = spark.createDataFrame([("wiki/x/big-page.md", "---\nrelated: [Big Page, '[[small|S]]', big-page, other]\n---\n"), ("wiki/x/small-1.md", ""), ("wiki/x/none.md", None)], "path string, content string")
    got = {r["path"]: r["content"] for r in upkeep.canonical_related(df).collect()}
    assert got["wiki/x/big-page.md"] == '---\nrelated: ["big-page", "small-1", "other"]\n---\n' and got["wiki/x/none.md"] is None
    refs = spark.createDataFrame([("small",), ("page",)], "ref string")
    ids = spark.createDataFrame([("small-1",), ("small-2",), ("a-page",), ("a-page",)], "id string")
    assert {tuple(r) for r in graph.resolve_cascade(refs, ids).collect()} == {("small", None), ("page", "a-page")}


def test_citations_queue_and_paths(spark):
    answers = spark.createDataFrame([(1, "<!-- cited: 2, 2x, 9 --> [1]"), (2, "<!-- cited: 9 --> [1] [1]"), (3, "[[l|x]]"), (4, None), (5, "")], "id int, text string")
    context = spark.createDataFrame([(k, n, f"p{n}") for k in (1, 2) for n in (1, 2)], "id int, position int, page string")
    assert {tuple(r) for r in upkeep.cited_pages(answers, context).collect()} == {(1, "note", 2, "p2"), (2, "number", 1, "p1"), (3, "link", None, "l")}
    snapshot = spark.createDataFrame([("a/b.md",), ("a/c/d.md",), ("ab/c.md",)], "path string")
    assert {r[0] for r in upkeep.known_paths(spark.createDataFrame([("a",), ("a/c",)], "path string"), snapshot).collect()} == {"a/b.md", "a/c/d.md"}
    queue = spark.createDataFrame([(1, "failed", "e", 3, True), (2, "done", "e", 1, False)], "task int, status string, error string, retry_count int, needs_rerun boolean")
    assert {tuple(r) for r in upkeep.retry(queue).collect()} == {(1, "pending", None, 0, False), (2, "done", "e", 1, False)}
    groups = spark.createDataFrame([(["b", "A"],), (["a", "B"],), (["c", "d"],), (["e"],)], "slugs array<string>")
    assert [r["slugs"] for r in upkeep.unsuppressed(groups, spark.createDataFrame([(["D", "C"],)], "slugs array<string>")).collect()][0] in (["b", "A"], ["a", "B"])
    assert upkeep.display_weights(spark.createDataFrame([(1, 2, 0.5)], "a int, b int, weight double")).first()["size"] == 2.25


def test_candidates_are_dealt_to_more_tasks_the_more_rows_there_are(spark, monkeypatch):
    monkeypatch.setattr(upkeep, "TASK_ROWS", 20)
    rows = [(k % 13, (k * 7) % 3, k * 5 % 101, k % 17) for k in range(400)]
    got = upkeep.candidates(spark.createDataFrame(rows, "key long, tier int, rank long, slug long"), 4)
    want = set()
    for key in range(13):
        first = {}
        for _, tier, rank, slug in (r for r in rows if r[0] == key):
            first[slug] = min(first.get(slug, (9, 0, 0)), (tier, rank, slug))
        want |= {(key, slug, at + 1) for at, (_, _, slug) in enumerate(sorted(first.values())[:4])}
    assert {tuple(r) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 20
