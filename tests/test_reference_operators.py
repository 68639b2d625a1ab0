"""Retrieval, graph, quality, dedup, change feed, chunking and source operators on small corpora."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lexaloom.functions import text as T
from lexaloom.operators import changes, chunking, dedup, graph, quality, retrieval
from lexaloom.sources import pages as sources
from lexaloom.streaming import feed


def page(title, body, **fields):
    lines = "".join(f"{k}: {v}\n" for k, v in {"title": title, **fields}.items())
    return f"---\n{lines}---\n\n# {title}\n\n{body}\n"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("wiki/concepts/attention.md", page("Attention", "weights [[transformer|Transformers]]", type="concept", created="2024-01-01", tags="[a, \"b, c\"]")),
        ("wiki/entities/transformer.md", page("Transformer", "uses [[attention]] and [[missing one]] ![x](img/a.png) ![y](img/a.png)", type="entity", related="\n  - attention\n  - Some Page")),
        ("wiki/entities/other.md", page("Other", "nothing here", type="entity", created="2024-01-02")),
        ("wiki/entities/GPT4.md", "no front matter\n"),
        ("wiki/entities/gpt-4.md", page("GPT 4", "")),
    ]
    return spark.createDataFrame(rows, "path string, content string")


def test_tokens_and_phrases():
    assert T.query_tokens("What is the Attention, of heads?") == ["attention", "heads"]
    assert T.query_tokens("注意力机制") == sorted(["注意力机制", "注意", "意力", "力机", "机制", "注", "意", "力", "机", "制"])
    assert T.query_phrase("  «Hello world!» ") == "hello world"


def test_page_fields(pages):
    got = {r["path"]: r for r in sources.parse_pages(pages).collect()}
    a, t = got["wiki/concepts/attention.md"], got["wiki/entities/transformer.md"]
    assert (a["id"], a["title"], a["type"], a["tags"], a["links"]) == ("concepts/attention", "Attention", "concept", ["a", "b, c"], ["transformer"])
    assert t["related"] == ["attention", "Some Page"] and t["images"] == ["img/a.png"] and t["links"] == ["attention", "missing one"]
    assert got["wiki/entities/GPT4.md"]["title"] == "GPT4" and got["wiki/entities/GPT4.md"]["type"] == "other"


def test_names(spark):
    rows = [("MapReduce 2.0", "map-reduce-2-0", "mapreduce20"), ("  Hello, World ", "hello-world", "helloworld"), ("x" * 50 + " " + "y" * 50, "x" * 50, "x" * 50 + "y" * 50)]
    df = spark.createDataFrame([(r[0],) for r in rows], "n string")
    got = df.select(T.page_id(F.col("n")), T.dedup_key(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
    assert [r[0] for r in spark.createDataFrame([("Missing page: Foo  Bar",), ("!!",)], "n string").select(T.review_title(F.col("n"))).collect()][0] == "foo bar"
    assert spark.createDataFrame([("!!",)], "n string").select(T.query_slug(F.col("n"))).first()[0] == "query"


@pytest.mark.parametrize(
    "text,language",
    [("これは日本の話です", "Japanese"), ("这是中文", "Chinese"), ("Привет", "Russian"), ("Grüße", "English"), ("garçon", "English"), ("mañana", "Spanish"), ("Acesta este un text și o casă", "Romanian"), ("Țară și oraș", "English"), ("ёж αβγδε", "Greek"), ("ёж αβ", "Russian"), (None, "English"), ("hello", "English"), ("", "English")],
)
def test_language(spark, text, language):
    assert spark.createDataFrame([(text,)], "t string").select(T.detect_language(F.col("t"))).first()[0] == language


def test_language_by_words(spark):
    """The reference's sentences, and one for each language that only words tell."""
    want = {
        "der Hund und die Katze sind nicht das Problem": "German", "le chat noir et les chiens blancs, un homme et une femme": "French",
        "le chat est là, les étudiants préfèrent le café": "French", "el nino y los libros del colegio que son para todos": "Spanish",
        "o coração do Brasil é um lugar de paz e que encanta": "Portuguese", "dzień dobry świat": "Polish", "Xử lý nước thải": "Vietnamese",
        "Việt Nam là một quốc gia xinh đẹp": "Vietnamese", "سلام دنیا، این یک متن فارسی برای آزمایش است": "Persian", "اللغة العربية مهمة في العالم": "Arabic",
        "سلام": "Arabic", "مرحبا بالعالم": "Arabic", "机器学习 machine learning 深度学习 神经网络": "Chinese", "x中": "English", "abc xyz 123": "English", "123 !@#$": "English",
        "il gatto che dorme": "Italian", "het huis van mijn vader": "Dutch", "jag är här och du är där": "Swedish", "jeg er på vei og kommer": "Norwegian",
        "tid til æbler": "Danish", "tämä ja tuo": "Finnish", "buku yang baik": "Indonesian", "habari ya leo": "Swahili", "ನಮಸ್ಕಾರ": "Kannada",
        "The Märklin train was late": "English", "forever and a day": "English",
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", T.detect_language(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == want


def test_keyword_search(spark):
    rows = [("wiki/a/attention.md", "Attention", "attention.md", "about attention heads, attention"), ("wiki/a/other.md", "Other", "other.md", "nothing"), ("wiki/a/t.md", "Transformer", "t.md", "attention is used")]
    df = spark.createDataFrame(rows, "path string, title string, file_name string, content string")
    got = {r["path"]: r["score"] for r in retrieval.keyword_scores(df, "attention").collect()}
    assert got == {"wiki/a/attention.md": 200 + 50 + 40 + 5 + 1, "wiki/a/t.md": 20 + 1}
    hits = retrieval.hybrid_search(df, spark.createDataFrame([(1, "wiki/a/other.md", [0.0, 1.0]), (2, "wiki/a/t.md", [1.0, 0.0])], "vec_id long, page string, embedding array<double>"), "attention", [1.0, 0.0]).collect()
    assert hits[0]["path"] == "wiki/a/t.md" and abs(hits[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert {r["path"]: r["mode"] for r in hits} == {"wiki/a/t.md": "hybrid", "wiki/a/attention.md": "keyword", "wiki/a/other.md": "vector"}


def test_packing_skips_and_goes_on(spark):
    items = spark.createDataFrame([("q", 1, 60), ("q", 2, 50), ("q", 3, 30), ("q", 4, 20)], "q string, p int, size long")
    assert [r["p"] for r in retrieval.pack_context(items, "q", ["p"], "size", 100).orderBy("p").collect()] == [1, 3]


def test_resolution(spark):
    ids = spark.createDataFrame([("entities/apache-spark",), ("concepts/rdd",), ("entities/rdd",), ("apache-flink",), ("My Page",)], "id string")
    refs = ["entities/apache-spark", "Apache-Flink", "spark", "rdd", "flink", "apache", "my page", "concepts/RDD.md", "none"]
    got = dict(graph.resolve_cascade(spark.createDataFrame([(r,) for r in refs], "ref string"), ids).collect())
    assert got == {"entities/apache-spark": "entities/apache-spark", "Apache-Flink": "apache-flink", "spark": "entities/apache-spark", "rdd": None, "flink": "apache-flink", "apache": "apache-flink", "my page": "My Page", "concepts/RDD.md": "concepts/rdd", "none": None}
    strict = dict(graph.resolve_strict(spark.createDataFrame([("spark",), ("MY PAGE",)], "ref string"), ids).collect())
    assert strict == {"spark": None, "MY PAGE": "My Page"}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert dict(graph.link_counts(edges).collect()) == {1: 3, 2: 3, 3: 2, 4: 1, 5: 1}
    nodes = spark.createDataFrame([(k, "entity" if k < 3 else "concept") for k in range(1, 6)], "id long, type string")
    none = spark.createDataFrame([], "src long, dst long")
    r = {(x["a"], x["b"]): x for x in graph.relevance(nodes, edges, none, spark.createDataFrame([(1, "s"), (2, "s")], "id long, source string")).collect()}
    import math

    assert r[1, 2]["direct"] == 2 and r[1, 2]["shared"] == 1 and abs(r[1, 2]["relevance"] - (6 + 4 + 1.5 / math.log(2) + 0.8)) < 1e-9
    weighted = graph.undirected(edges).withColumn("weight", F.lit(1.0))
    found = dict(graph.communities(weighted).collect())
    assert found[1] == found[2] == found[3] != found[4] and found[4] == found[5]


def test_louvain(spark):
    cliques = [(10 * c + i, 10 * c + j) for c in range(5) for i in range(6) for j in range(i)]
    ring = [(10 * c, 10 * ((c + 1) % 5) + 1) for c in range(5)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in cliques + ring], "a long, b long, weight double")
    got = graph.louvain(edges)
    found = dict(got.collect())
    assert len(set(found.values())) == 5 and all(found[10 * c + i] == 10 * c for c in range(5) for i in range(6))
    assert graph.modularity(edges, got) >= graph.modularity(edges, graph.communities(edges)) - 1e-9 and graph.modularity(edges, got) > 0.7
    assert [(r["number"], r["size"]) for r in graph.numbered(got).orderBy("number").collect()] == [(k, 6) for k in range(5)]
    assert graph.louvain(edges.limit(0)).count() == 0


def test_louvain_and_labels_settle(spark):
    """A long chain of planted pairs needs more levels and rounds than any fixed few."""
    import random

    rng, weight = random.Random(3), {}
    for c in range(10):  # groups of 8, some edges between neighbouring groups
        for i in range(8):
            for j in range(i):
                if rng.random() < 0.6 or j == i - 1:
                    weight[8 * c + j, 8 * c + i] = 1.0
        weight[8 * c + rng.randrange(8), 8 * (c + 1) + rng.randrange(8)] = 1.0
    for k in range(1000, 1060):  # a chain
        weight[k, k + 1] = 1.0
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "a long, b long, weight double")
    of = dict(graph.louvain(edges).collect())
    total, degree, size = sum(weight.values()), dict.fromkeys(of, 0.0), {}
    for (a, b), w in weight.items():
        degree[a] += w
        degree[b] += w
    for n, c in of.items():
        size[c] = size.get(c, 0.0) + degree[n]
    between = {}
    for (a, b), w in weight.items():
        if of[a] != of[b]:
            pair = tuple(sorted((of[a], of[b])))
            between[pair] = between.get(pair, 0.0) + w
    assert all(w - size[a] * size[b] / (2 * total) < 1e-6 for (a, b), w in between.items())  # no merge raises modularity
    label = dict(graph.communities(edges).collect())
    near = {n: {} for n in of}
    for (a, b), w in weight.items():
        for u, v in ((a, b), (b, a)):
            near[u].setdefault(label[v], 0.0)
            near[u][label[v]] += w
    for n, votes in near.items():
        votes[label[n]] = votes.get(label[n], 0.0) + 1.0
        assert min(votes, key=lambda x: (-votes[x], x)) == label[n]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁne Ｗide",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(T.nfkc(F.col("t"))).collect()] == ["fine Wide", "plain", None]


def test_quality(pages, spark):
    rules = {(r["rule"], r["subject"]) for r in quality.audit(pages).collect()}
    assert ("DUP-SLUG-VERSION-NUMBER", "gpt4") in rules and ("FRONTMATTER-INCONSISTENT-LIST", "wiki/entities/transformer.md") in rules
    bad = {(r["path"].rsplit("/", 1)[1], r["violation"]) for r in quality.validate(pages).collect()}
    assert ("GPT4.md", "missing-frontmatter") in bad and ("transformer.md", "missing-required:created") in bad and not any(p == "attention.md" for p, _ in bad)
    reviews = spark.createDataFrame([("r1", "missing-page", "Missing page: Other", None), ("r2", "missing-page", "Missing page: Nope", None), ("r3", "duplicate", "x", ["other", "gone"])], "id string, type string, title string, affected array<string>")
    slugs = [("concepts/ab", "---\ntitle: Ab\n---\n[[ab]] [[AB]] [[a-b]] [[gone]] [[Gone Page]] [[x(y]] [[Same]]"), ("concepts/a-b", "--- \ntext"), ("concepts/AB", "_Stub page — batched ingest did not emit this file"), ("entities/missing-page-x", "---\ntitle: Other name\nrelated: [\"[[ab|x]]\", \"No Slug\"]\n---\n"), ("concepts/same", "b"), ("concepts/SAME", "b"), ("concepts/abc", "b")]
    made = spark.createDataFrame([(f"wiki/{k}.md", c) for k, c in slugs], "path string, content string")
    found = {(r["rule"], r["subject"].rsplit("/", 1)[-1], r["detail"]) for r in quality.audit(made).collect()}
    assert found == {
        ("DUP-SLUG-PUNCTUATION", "ab", "AB,a-b,ab"), ("DUP-SLUG-PUNCTUATION", "same", "SAME,same"), ("DUP-SLUG-CASE", "same", "SAME,same"),
        ("STUB-UNFILLED", "AB.md", ""), ("FRONTMATTER-DELIMITER-WHITESPACE", "a-b.md", "--- "), ("MISSING-PAGE-PLACEHOLDER", "missing-page-x.md", ""), ("PAGE-EMPTY", "missing-page-x.md", ""),
        ("TITLE-SLUG-MISMATCH", "missing-page-x.md", "missing,page,x"), ("FRONTMATTER-INCONSISTENT-LIST", "missing-page-x.md", "No Slug"),
        ("LINK-SELF-REFERENCE", "ab.md", "ab"), ("LINK-SELF-REFERENCE", "ab.md", "AB"), ("LINK-MALFORMED-TEXT", "ab.md", "x(y"),
        ("LINK-BROKEN-NONEXISTENT", "ab.md", "gone"), ("LINK-TITLE-FORM", "ab.md", "Gone Page"), ("LINK-TITLE-FORM", "ab.md", "x(y"), ("LINK-CASE-MISMATCH", "ab.md", "Same"),
    }
    assert dict(quality.sweep(reviews, pages).collect()) == {"r1": True, "r2": False, "r3": True}


def test_dedup(spark):
    names = spark.createDataFrame([("GPT-4",), ("gpt4",), ("gpt 5",), ("Other",)], "name string")
    assert [tuple(r) for r in dedup.clusters(names).collect()] == [("gpt4", 2, "GPT-4,gpt4")]
    p = spark.createDataFrame([("a", ["X", "y"], [], ["s1"]), ("b", ["x", "Z"], ["q"], ["s2", "S1"])], "slug string, tags array<string>, related array<string>, sources array<string>")
    m = dedup.merge_groups(p, spark.createDataFrame([("a", "b"), ("b", "b")], "slug string, canonical string")).first()
    assert (m["tags"], m["related"], m["sources"]) == (["x", "Z", "y"], ["q"], ["s2", "S1"])
    fate = {r["id"]: (r["fate"], r["sources"]) for r in dedup.delete_source(p.select(F.col("slug").alias("id"), "sources"), "s1").collect()}
    assert fate == {"a": ("delete", []), "b": ("rewrite", ["s2"])}
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert dedup.upsert(base, base.limit(0), "k").count() == 3
    assert sorted(map(tuple, dedup.upsert(base, spark.createDataFrame([(1, "z")], base.schema), "k").collect())) == [(1, "z"), (2, "c")]
    sets = dedup.candidate_sets(spark.createDataFrame([(["a", "b"],), (["c", "d"],)], "names array<string>"), spark.createDataFrame([("a", "b"), ("a", "x")], "seed string, other string"), spark.createDataFrame([("a",)], "name string"))
    assert sorted(r[0] for r in sets.collect()) == [["a", "b"], ["a", "b", "x"]]


def test_changes(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert dict(changes.snapshot_diff(before, after, "path", ["hash"]).collect()) == {"b": "Modified", "c": "Deleted", "d": "Created"}
    q = spark.createDataFrame([("a", "processing", 0, False), ("b", "failed", 3, False), ("c", "failed", 1, False)], "path string, status string, retry_count int, needs_rerun boolean")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    got = {r["path"]: (r["status"], r["needs_rerun"]) for r in changes.upsert_tasks(q, new).collect()}
    assert got == {"a": ("processing", True), "b": ("failed", False), "c": ("pending", False), "d": ("pending", False)}


def test_chunks():
    text = "# One\n\n" + "A sentence here. " * 100 + "\n\n```\n" + "code line\n" * 200 + "```\n\n## Two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n# not\n"
    chunks = chunking.chunk_markdown(text)
    assert {c[1] for c in chunks} == {"One", "One > Two", "not"}
    assert any(c[4] and "code line" in c[0] for c in chunks) and all(len(c[0]) <= 1700 for c in chunks if not c[4])
    assert chunking.chunk_markdown("") == [] and [c[0] for c in chunking.chunk_markdown("short")] == ["short"]
    plain = "word " * 2000
    parts = chunking.chunk_markdown(plain, overlap=0)
    assert "".join(c[0] for c in parts) == plain
    assert chunking.chunk_markdown("x" * 5000, overlap=0)[0][0] == "x" * 1000
    front = "---\ntitle: T\n---\n"
    with_front = chunking.chunk_markdown(front + text)
    assert [(t, p, a - len(front), b - len(front), o) for t, p, a, b, o in with_front] == chunks
    assert all((front + text)[a:b][-5:] == t[-5:] and a < b for t, _, a, b, _ in with_front)
    assert max(len(c[0]) for c in chunking.chunk_markdown(plain, target=100, most=100, least=0, overlap=500)) <= 150


def test_html_and_files(spark, tmp_path):
    html = "<html><head><title>T</title></head><body><nav>menu</nav><h1>Hi &amp; you</h1><p>a <b>b</b> <a href=\"u\">c</a></p><ul><li>x</li></ul><script>no</script></body></html>"
    assert sources.markdown_of(html) == "# Hi & you\n\na **b** [c](u)\n\n- x"
    assert sources.markdown_of(None) == ""
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp;</w:t><w:t xml:space='preserve'> two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "a.md").write_text("# A")
    (tmp_path / "wiki" / ".hidden.md").write_text("no")
    assert [r["content"] for r in sources.scan_pages(spark, str(tmp_path)).collect()] == ["# A"]
    files = spark.read.format("binaryFile").load(str(tmp_path / "d.docx"))
    assert sources.extract_files(files).first()["content"] == "One & two\nthree"


def test_streams(spark, tmp_path):
    schema = "path string, status string, ts timestamp"
    for k, rows in enumerate([[("a", "changed", 1), ("a", "processing", 2), ("a", "changed", 3), ("b", "changed", 1)], [("a", "done", 4), ("b", "failed", 5), ("b", "failed", 6), ("b", "failed", 7)]]):
        spark.createDataFrame(rows, "path string, status string, t int").selectExpr("path", "status", "timestamp_seconds(t) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = feed.run_to_table(spark, feed.task_states(stream), "update")
    last = {r["path"]: r for r in out.orderBy("n_changes").collect()}
    assert (last["a"]["status"], last["a"]["needs_rerun"]) == ("pending", False) and (last["b"]["status"], last["b"]["retry_count"]) == ("failed", 3)


def test_catalog_is_whole():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 40 and set(entry.oracle_sql()) <= set(entry.queries())


def test_changes_are_folded_one_by_one(spark, monkeypatch):
    """Against a fold by hand, in whole rows and in runs of three."""
    import random

    from lexaloom.operators import changes

    rng = random.Random(2)
    rows = [(p, k, rng.choice(changes.KINDS)) for p in range(40) for k in range(rng.randint(1, 12))] + [(100, k, v) for k, v in enumerate(["Created", "Deleted", "Created"])] + [(101, k, v) for k, v in enumerate(["Deleted", "Created", "Deleted"])]
    want = {}
    for p, _, kind in rows:
        old = want.get(p)
        want[p] = "Modified" if kind == "Modified" or {old, kind} == {"Created", "Deleted"} else kind
    assert (want[100], want[101]) == ("Created", "Deleted")
    df = spark.createDataFrame(rows, "path long, k long, kind string")
    for run in (changes.RUN, 3):
        monkeypatch.setattr(changes, "RUN", run)
        got = changes.coalesce_changes(df.repartition(3), "path", ["k"]).collect()
        assert {r["path"]: r["kind"] for r in got} == want and sum(r["n"] for r in got) == len(rows)


def test_refused_requests_do_not_count(spark):
    from lexaloom.operators import changes

    rows = [("a", k, t) for k, t in enumerate([0, 1, 2, 9, 10, 11, 12])] + [("b", 9, 1), (None, 10, 1)]
    got = {r["event_id"]: (r["n_recent"], r["allowed"]) for r in changes.rate_limited(spark.createDataFrame(rows, "key string, event_id long, at long"), "key", "event_id", "at", 2, 10).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (2, False), 3: (2, False), 4: (2, False), 5: (1, True), 6: (1, True), 9: (0, True), 10: (0, True)}


def test_ranks_beyond_any_depth(spark):
    """A vector page's keyword rank counts wherever it stands."""
    words = spark.createDataFrame([(f"p{k:03d}", float(1000 - k)) for k in range(300)], "path string, score double")
    hits = spark.createDataFrame([("p250", 0.9), ("q", 0.8)], "path string, score double")
    got = {r["path"]: (r["score"], r["mode"]) for r in retrieval.fused_pages(words, hits, 5).collect()}
    assert got["p250"] == (1 / 61 + 1 / 311, "hybrid") and got["q"] == (1 / 62, "vector") and got["p000"] == (1 / 61, "keyword") and len(got) == 5


def test_greetings_and_titles(spark):
    from lexaloom.functions import markup as M

    want = {"hi": True, "  Hello there!! ": True, "good morning": True, "你好呀。": True, "Thanks": False, "hello, how do I train a model?": False, "": False, "hi " * 8: False, "早": True, "안녕하세요": True, ".hi": False}
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", M.is_greeting(F.col("t"))).collect()} == want
    titles = {"Missing page: Foo  Bar": "foo bar", "missing-page：X": "x", "疑似重复: A b": "a b", "Duplicatepage:Q": "q", "possible duplicate: Z": "z", "缺少页面：你": "你", "Other: x": "other: x"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.review_title(F.col("t"))).collect()} == titles


def test_chunks_of_fences_and_sentences():
    """Only its own mark ends a code block, overlaps begin with sentences, and places lie in the text."""
    code = "```\n~~~\n# not heading\n````\n```\n"
    text = f"# H\n\n{code}\nafter\n\n ```\n# Real\nx"
    got = [(p, t) for p, _, t in chunking.sections(text)]
    assert [p for p, _ in got] == ["H", "Real"] and code in got[0][1]
    assert [(a, w) for _, a, w in chunking.atoms(code, 0)] == [(code, True)]
    assert [w for *_, w in chunking.atoms("~~~~\na\n~~~\nb\n~~~~\nrest\n", 0)] == [True, False]
    assert chunking.snapped("nd here. Sentence two goes") == "Sentence two goes" and chunking.snapped("half word") == "word" and chunking.snapped("end.") == "end." and chunking.snapped("word") == "word"
    body = " ".join(f"Sentence number {k} ends here." for k in range(200))
    made = chunking.chunk_markdown(body)
    assert len(made) > 4 and all(body[start:end] == chunk for chunk, _, start, end, _ in made)
    assert all(chunk.startswith("Sentence") for chunk, *_ in made)
    tables = "text\n| a | b |\n|---|---|\n| 1 | 2 |\n | c |\n| alone |\n"
    assert [w for *_, w in chunking.atoms(tables, 0)] == [False, True, False, False]


def test_marks_of_latin_languages(spark):
    """Letters that mark a language are looked for in what is left of a text without ASCII, and its words are those that mark one."""
    assert all(not any(c.isascii() for c in letters.strip("[]")) for _, letters, _ in T.LATIN)
    texts = [f"{a} {b} xyz" for letters in ["ğ", "ą", "ě", "ő", "ñ", "å", "ö", "ã", ""] for a in [letters] for b in ["und", "le", "bir", "och", "og", "ja", "unden", "för", "é", "que", "na"]]
    low = F.col("t")
    words = F.array_distinct(F.split(low, "[^a-z0-9_]+"))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.detect_language(low).alias("x"), T._latin(low, low, words).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got) and len({r["x"] for r in got}) > 8
