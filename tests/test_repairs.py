"""Repairs of written pages: a case for each rule, source fragments, and that all rules change nothing the second time."""

import random

from pyspark.sql import functions as F

from lexaloom.functions import repairs

GOOD = "---\ntype: entity\ntitle: A\nsources: [\"a.pdf\"]\n---\n\n# A\n\ntext [[b|B]] and [[c]]\n"
CASES = [
    ("kept", GOOD, GOOD),
    ("prose", "About type: and title: in prose.\n", "About type: and title: in prose.\n"),
    ("editor-marks", "\\---\ntype: entity\ntitle: A\n\\---\n\\[\\[a\\]\\]\n<br />\n\n\n\n\nx", "---\ntype: entity\ntitle: A\n---\n[[a]]\n\n\nx"),
    ("joined-files", "---\ntype: a\n---\nbody\n\n---FILE: wiki/b.md---\nother", "---\ntype: a\n---\nbody\n"),
    ("rules", "***\n***\n---\ntype: a\n---\nx\n***\ny\n------------\nz\n***\n", "---\ntype: a\n---\nx\n\ny\nz\n"),
    ("yaml-fence", "---yaml\ntype: a\n---\nx", "---\ntype: a\n---\nx"),
    ("yaml-fence", "---YML---\ntype: a\n---\nx", "---\ntype: a\n---\nx"),
    ("glued-end", '---\ntype: a\nsources: ["x.pdf"]]---\nbody', '---\ntype: a\nsources: ["x.pdf"]\n---\nbody'),
    ("glued-end", "---\ntype: a\ntitle: My title---\nbody", "---\ntype: a\ntitle: My title\n---\nbody"),
    ("glued-start", "--- type: a\ntitle: b\n---\nx", "---\ntype: a\ntitle: b\n---\nx"),
    ("glued-start", "---type: a\ntitle: b\n---\nx", "---\ntype: a\ntitle: b\n---\nx"),
    ("missing-end", "---\ntype: a\nsources: [x]\n# Body", "---\ntype: a\nsources: [x]\n---\n# Body"),
    ("missing-end", "---\ntype: a\nsources: [x]", "---\ntype: a\nsources: [x]\n---\n"),
    ("outer-fence", "```markdown\n---\ntype: a\n---\nx\n```\n", "---\ntype: a\n---\nx"),
    ("key-prefix", "frontmatter:\n---\ntype: a\n---\nx", "---\ntype: a\n---\nx"),
    ("inline-fields", "type: entity title: A B tags: [x, y] sources: [a.pdf]\n\n# A\ntext", "---\ntype: entity\ntitle: A B\ntags: [x, y]\nsources: [a.pdf]\n---\n\n# A\ntext"),
    ("inline-fields", "type: entity\ntitle: A\n---\n\nbody", "---\ntype: entity\ntitle: A\n---\n\nbody"),
    ("field-links", "---\ntype: a\nrelated: [[a]], [[b]]\n---\n[[c]], [[d]]", '---\ntype: a\nrelated: ["[[a]]", "[[b]]"]\n---\n[[c]], [[d]]'),
    ("field-links", "---\nrelated: [[[a]], [[b c]], plain]\ntitle: [[a|The A]]\nsources: [\"[[x.pdf]]\"]\n---\n", '---\nrelated: [a, "b c", plain]\ntitle: "The A"\nsources: ["x.pdf"]\n---\n'),
    ("split-sources", '---\nsources: [Smith, 2020, report.pdf, "Smith, 2020, report.pdf"]\n---\nx', '---\nsources: ["Smith, 2020, report.pdf"]\n---\nx'),
    ("second-end", "---\ntype: a\n---\n---\nbody", "---\ntype: a\n---\nbody"),
]


def steps(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    made = df.select("k", repairs.repair_steps(F.col("t")).alias("s"))
    return [(r["s"]["text"], r["s"]["rules"]) for r in made.orderBy("k").collect()]


def test_each_rule(spark):
    got = steps(spark, [t for _, t, _ in CASES] + [None, ""])
    for (name, _, want), (text, rules) in zip(CASES, got[:-2], strict=True):
        assert text == want, (name, text)
        assert rules == [] if name in ("kept", "prose") else name in rules, (name, rules)
    assert got[-2:] == [(None, []), ("", [])]


def test_twice_changes_nothing(spark):
    rng = random.Random(12)
    bits = ["---", "---\n", "\n", "type: a", "title: [[x|Y]]", "tags: [a, b]", "related: [[a]], [[b]]", "sources: [\"x.pdf\"]]---", "sources: [a, b.pdf]", "```yaml\n", "```", "***", "text", "# H", "\\[", "<br>",
            "frontmatter:", " ", "---yaml", "--------------", "---FILE: w/a.md---", "\r\n", "[[[q]], w]", "related: ", "description: d---"]
    texts = [t for _, t, _ in CASES] + ["".join(rng.choice(bits) + rng.choice(["", "\n", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    once = [t for t, _ in steps(spark, texts)]
    twice = steps(spark, once)
    odd = [(a, b, c, rules) for a, b, (c, rules) in zip(texts, once, twice, strict=True) if b != c]
    assert not odd, (len(odd), odd[:3])


def test_source_fragments(spark):
    rows = [
        (["a.pdf"], ["a.pdf"]), ([" a ", ""], ["a"]), ([], []), (["Smith", "2020.pdf", "Smith, 2020.pdf"], ["Smith, 2020.pdf"]), (["Smith", "2020", "report.pdf"], ["Smith, 2020, report.pdf"]),
        (["a.pdf", "b.pdf"], ["a.pdf", "b.pdf"]), (["notes", "other"], ["notes", "other"]), (["x", "A very long name of a report.pdf"], ["A very long name of a report.pdf"]),
    ]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(rows)], "k int, s array<string>")
    assert [r["x"] for r in df.select("k", repairs.whole_sources(F.col("s")).alias("x")).orderBy("k").collect()] == [w for _, w in rows]


def test_a_pass_without_changes_settles(spark):
    """Settled texts are those that mending again leaves as they are, found without going through the rules again."""
    texts = ["---yaml\ntype: entity\nrelated: [[a]], [[b]]\n---\nbody", "body", "", "frontmatter:\n---\ntype: entity\n---\nx", "```md\n---\ntype: entity\n---\nx\n```\n"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", repairs.repair_steps(F.col("t")).alias("m"))
    rows = df.select("t", "m.*", repairs.repaired(F.col("m.text")).alias("again")).collect()
    assert all(r["settled"] and r["again"] == r["text"] for r in rows)
    assert [bool(r["rules"]) for r in rows] == [True, False, False, True, True, False]
