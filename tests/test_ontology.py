"""Page types induced from pages, findings of each code, fixes that leave no date or type out."""

from lexaloom.functions.front_matter import locate, read_fields
from lexaloom.operators import ontology as O

DAY = "2026-01-02"
FULL = "created: 2024-01-01\nupdated: 2024-01-02"
PAGES = [
    ("wiki/entities/a.md", f"---\ntype: entity\ntitle: A\n{FULL}\nstatus: active\n---\nbody"),
    ("wiki/entities/b.md", "---\ntitle: B\n---\nbody"),  # type and dates come from the folder and the day
    ("wiki/entities/c.md", f"---\ntype: concept\ntitle: C\n{FULL}\n---\n"),
    ("wiki/entities/d.md", f"---\ntype: entity\ntitle: ''\n{FULL}\nstatus: odd\nsources: []\n---\n"),
    ("wiki/entities/e.md", "no block"),
    ("wiki/recipes/f.md", f"---\ntype: Recipe\ntitle: F\nserves: 4\ntags: [x, y]\n{FULL}\n---\n"),
    ("wiki/recipes/g.md", f"---\ntype: recipe\ntitle: G\nserves: 2\n{FULL}\n---\n"),
    ("wiki/other/h.md", f"---\ntype: recipe\ntitle: H\nserves: 1\nnote: n\n{FULL}\n---\n"),
    ("wiki/index.md", "no block"), ("raw/x.md", "no block"), ("wiki/entities/null.md", None), ("wiki/root.md", f"---\ntype: note\ntitle: R\n{FULL}\n---\n"),
]


def frames(spark):
    pages = spark.createDataFrame(PAGES, "path string, content string").repartition(3)
    return pages, O.given(spark, {"entity": {"status": ["active", "gone"]}})


def test_induction(spark):
    pages, known = frames(spark)
    got = {r["type"]: r for r in O.induced(pages, known).collect()}
    assert set(got) == {"recipe", "note"}
    assert tuple(got["recipe"])[1:4] == ("recipes", 3, 2) and got["recipe"]["required"] == ["created", "serves", "title", "type", "updated"]
    assert tuple(got["note"])[1:4] == ("", 1, 0)
    merged = {r["type"]: r for r in O.bootstrapped(pages, known).collect()}
    assert set(merged) == {r["type"] for r in known.collect()} | {"recipe", "note"} and set(merged["recipe"]["required"]) <= {"type", "title", "created"}


def test_findings(spark):
    pages, known = frames(spark)
    rows = lambda df: sorted((r["path"].rsplit("/", 1)[-1], r["severity"], r["code"], r["field"]) for r in df.collect())
    want = [
        ("c.md", "hard", "type-directory-mismatch", "type"), ("d.md", "hard", "missing-required", "title"), ("d.md", "soft", "invalid-enum", "status"), ("e.md", "hard", "missing-frontmatter", None),
        ("f.md", "hard", "unknown-type", "type"), ("g.md", "hard", "unknown-type", "type"), ("h.md", "hard", "unknown-type", "type"), ("null.md", "hard", "missing-frontmatter", None), ("root.md", "hard", "unknown-type", "type"),
    ]
    assert rows(O.violations(pages, known, DAY)) == want
    later = rows(O.violations(pages, O.bootstrapped(pages, known), DAY, permissive=True))
    assert {s for _, s, *_ in later} == {"soft"} and [x[0] for x in later] == ["c.md", "d.md", "d.md", "e.md", "h.md", "null.md"]
    said = {r["path"].rsplit("/", 1)[-1]: (r["title"], r["n_findings"], r["description"]) for r in O.reviews(O.violations(pages, known, DAY)).collect()}
    assert said["d.md"] == ("Schema: entities/d", 2, "invalid-enum status; missing-required title")


def test_fixes(spark):
    pages = [*PAGES, ("wiki/concepts/k.md", '---\ntitle: K\ncreated:\nupdated: ""\ntype: ~\ntags:\n  - x\n---\n\nbody\n'), ("wiki/zzz/l.md", "---\ntitle: L\n---\nbody")]
    df, known = spark.createDataFrame(pages, "path string, content string"), frames(spark)[1]
    got = {r["path"].rsplit("/", 1)[-1]: r for r in O.fixes(df, known, DAY).collect()}
    assert set(got) == {"b.md", "k.md", "l.md"} and got["b.md"]["added"] == ["type", "created", "updated"] and got["l.md"]["added"] == ["created", "updated"]
    assert read_fields(locate(got["b.md"]["content"])[0]) == {"title": "B", "type": "entity", "created": DAY, "updated": DAY} and got["b.md"]["content"].endswith("---\n\nbody")
    assert read_fields(locate(got["k.md"]["content"])[0]) == {"title": "K", "tags": ["x"], "type": "concept", "created": DAY, "updated": DAY}
    again = spark.createDataFrame([(r["path"], r["content"]) for r in got.values()], "path string, content string")
    assert O.fixes(again, known, DAY).count() == 0
    empty = df.limit(0)
    assert O.induced(empty, known).count() == O.violations(empty, known, DAY).count() == O.fixes(empty, known, DAY).count() == 0
