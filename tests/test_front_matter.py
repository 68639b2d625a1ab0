"""Front matter: blocks in odd places, the YAML that pages use, link repair, broken blocks, and read-write-read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexaloom.functions import front_matter as M


def fields(text):
    found = M.locate(text)
    return M.read_fields(found[0]) if found else None


def test_blocks_and_bodies():
    assert M.locate("# Title\n\ntext\n") is None
    assert M.locate("---\ntitle: A\n---\n# Body\n") == ("title: A", "---\ntitle: A\n---\n", "# Body\n")
    assert M.locate("---\ntitle: A\n---") == ("title: A", "---\ntitle: A\n---", "")
    text = "---\r\ntitle: A\r\ntags: [a, b]\r\n---\r\nbody"
    assert M.locate(text)[1] + M.locate(text)[2] == text and fields(text) == {"title": "A", "tags": ["a", "b"]}
    for close in ("\n```\n", "```\n", "\n\n```\n"):
        found = M.locate(f"```yaml\n---\ntitle: A\n---\n{close}# Body\n")
        assert found[0] == "title: A" and found[2] == "# Body\n", close
    assert fields("frontmatter:\n---\ntitle: A\n---\nbody") == {"title": "A"} and M.locate("frontmatter:\n---\ntitle: A\n---\nbody")[2] == "body"
    assert fields("\n---\ntitle: A\n---\nbody") == {"title": "A"}
    assert M.locate("a\nb\nc\nd\ne\n---\nx: 1\n---\n") is not None and M.locate("a\nb\nc\nd\ne\nf\n---\nx: 1\n---\n") is None


READ = [
    ("tags: [a, b, c]", {"tags": ["a", "b", "c"]}), ("tags:\n  - a\n  - b", {"tags": ["a", "b"]}), ("tags:\n- a\n- \"b: c\"", {"tags": ["a", "b: c"]}),
    ("created: 2024-01-05", {"created": "2024-01-05"}), ("tags: [污水处理, 反硝化]", {"tags": ["污水处理", "反硝化"]}), ("title: \"Q: x\"\nother: 'it''s'", {"title": "Q: x", "other": "it's"}),
    ("n: 3\nf: 1.50\nt: true\ne:\nz: ~\ns: '3'", {"n": "3", "f": "1.5", "t": "true", "e": "", "z": "", "s": "3"}), ("related: [[a]], [[b]], [[c|d]]", {"related": ["[[a]]", "[[b]]", "[[c|d]]"]}),
    ("tags: [[red, blue], [green]]", {"tags": ['["red","blue"]', '["green"]']}), ("related:\n  - \"[[a]]\"\n  - '[[b]]'", {"related": ["[[a]]", "[[b]]"]}), ("tags: []", {"tags": []}),
    ("map: {a: 1, b: [x, y]}", {"map": '{"a":1,"b":["x","y"]}'}), ("map:\n  a: 1\n  b:\n    - x", {"map": '{"a":1,"b":["x"]}'}), ("text: |\n  one\n  two\nx: 1", {"text": "one\ntwo\n", "x": "1"}),
    ("text: >-\n  one\n  two", {"text": "one two"}), ("title: a b # note\n# line\n\nx: y", {"title": "a b", "x": "y"}), ("tags: [a,\n  b,\n  c]\nx: 1", {"tags": ["a", "b", "c"], "x": "1"}),
    ("title: long\n  goes on", {"title": "long goes on"}), ("url: https://a.b/c:d", {"url": "https://a.b/c:d"}), ("sources: [raw/a.pdf, \"b, c.pdf\"]", {"sources": ["raw/a.pdf", "b, c.pdf"]}),
    ("list:\n  - a: 1\n    b: 2\n  - c", {"list": ['{"a":1,"b":2}', "c"]}),
    # no map of fields
    ("title: [unclosed", None), ("a: b: c", None), ("just text", None), ("- a\n- b", None), ("a: 1\na: 2", None), ("a: 1\n   b: 2", None), ("a: \"open", None), ("a: @x", None),
]


@pytest.mark.parametrize("payload,want", READ)
def test_fields(payload, want):
    assert M.read_fields(payload) == want


def test_written_pages_are_read_again():
    assert M.write_page({"type": "entity", "tags": [], "related": ["a", "[[b]]"]}, "\n# T\ntext \n\n") == '---\ntype: entity\ntags: []\nrelated:\n  - a\n  - "[[b]]"\n---\n\n\n# T\ntext\n'
    rng = random.Random(6)
    alphabet = ["a", "B", " ", ":", "#", "-", "'", '"', "[", "]", "{", "}", ",", "\n", "\t", "\\", "é", "漢", "1", ".", "|", ">", "~", "&", "*", "!", "%", "@", "`", "null", "true", "---", "\u2028"]
    text = lambda: "".join(rng.choices(alphabet, k=rng.randint(0, 8)))
    for _ in range(2000):
        made = {f"k{n}" if rng.random() < 0.8 else text() or "k": text() if rng.random() < 0.5 else [text() for _ in range(rng.randint(0, 3))] for n in range(rng.randint(1, 4))}
        page = M.write_page(made, "body")
        assert page.startswith("---\n") and fields(page) == made and M.locate(page)[2] == "body\n", page
        assert M.write_page(fields(page), "body") == page


def test_columns(spark):
    texts = [(1, "---\ntitle: A\ntags: [x, 'y']\n---\nbody"), (2, "no block"), (3, "```yaml\n---\ntitle: B\n---\n```\ntext"), (4, "---\ntitle: [\n---\nrest"), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "k int, t string").select("k", M.front_matter(F.col("t")).alias("m"))
    got = {r["k"]: (r["block"], r["body"], r["title"], r["fields"]) for r in df.select(
        "k", "m.block", "m.body", F.try_variant_get("m.fields", "$.title", "string").alias("title"), F.to_json("m.fields").alias("fields")
    ).collect()}
    assert got[1][:3] == ("---\ntitle: A\ntags: [x, 'y']\n---\n", "body", "A") and json.loads(got[1][3]) == {"title": "A", "tags": ["x", "y"]}
    assert got[2] == ("", "no block", None, None) and got[3][1:3] == ("text", "B") and got[4][1:] == ("rest", None, None) and got[5] == ("", None, None, None) and got[6] == ("", "", None, None)
    again = {r["k"]: r["p"] for r in df.select("k", M.page_text(F.col("m.fields"), F.col("m.body")).alias("p")).collect()}
    assert fields(again[1]) == {"tags": ["x", "y"], "title": "A"} and again[2] == "no block" and again[5] is None
