"""JSON in model output: nested braces, braces in strings, fences, escapes, broken tails and values of other types."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexaloom.functions import model_output as M


def each(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    return [r["x"] for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def brute(text, anywhere):
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escape = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escape:
            escape = False
        elif c == "\\" and (anywhere or quoted):
            escape = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


FENCED = [
    ('{"a": 1}', '{"a": 1}'), ("{}", "{}"), ('{"resolved": []}', '{"resolved": []}'), ('{\n  "a":  1\n}', '{\n  "a":  1\n}'), ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('```\n{"a": 1}\n```', '{"a": 1}'), ('```json {"a": 1} ```', '{"a": 1}'), ('  ```json\n{"a": 1}\n```  ', '{"a": 1}'), ('```JSON\n{"a": 1}\n```', '{"a": 1}'),
    ('Here is it: {"a": 1}', '{"a": 1}'), ('In {this} case {"a": 1}', "{this}"), ('{"a": {"b": {"c": 1}}} x', '{"a": {"b": {"c": 1}}}'), ('{"a": "x } y { z"}', '{"a": "x } y { z"}'),
    ('{"a": "say \\"}\\" now"}', '{"a": "say \\"}\\" now"}'), ('{"a": "c:\\\\"} }', '{"a": "c:\\\\"}'), ("no object", ""), ("", ""), ("   ", ""), ('{"a": 1', ""), ("{", ""), ("```json\n```", ""), (None, ""),
]


def test_fenced_objects(spark):
    assert each(spark, M.fenced_object, [t for t, _ in FENCED]) == [want for _, want in FENCED]


@pytest.mark.parametrize("escapes", ["anywhere", "strings"])
def test_objects_against_a_walk(spark, escapes):
    rng = random.Random(2)
    texts = ["".join(rng.choices('{}"\\ab \né', weights=[4, 4, 3, 2, 2, 2, 1, 1, 1], k=rng.randint(0, 40))) for _ in range(600)]
    texts.append("x" * 100_000 + '{"a": "' + "{" * 20_000 + '"}')
    assert each(spark, lambda c: M.first_object(c, escapes), texts) == [brute(t, escapes == "anywhere") for t in texts]


def test_parsers(spark):
    wrap = lambda x: f"Sure, here you go:\n```json\n{json.dumps(x)}\n```\nLet me know."
    group = {"slugs": ["a", "b", 3], "canonicalSlug": "b", "reason": "the {same}", "confidence": "high", "contradictory": True}
    texts = [
        wrap({"groups": [group, {"slugs": ["x", "y"], "canonicalSlug": "q", "confidence": "sure", "reason": 4, "contradictory": "true"}, {"slugs": ["one"]}, "text", None, {"slugs": "a"}]}),
        wrap({"groups": {"slugs": ["a", "b"]}}), '{"groups": [}', "nothing", wrap([1]), None,
    ]
    got = each(spark, M.duplicate_groups, texts)
    assert [[tuple(g) for g in x] for x in got] == [[(["a", "b"], "b", "the {same}", "high", True), (["x", "y"], "x", "", "low", False)], [], [], [], [], []]
    ids = each(spark, M.resolved_ids, ['```json\n{"resolved": ["r1", "r2", 3, null, "r1"]}\n```', '{"resolved": "r1"}', "{}", "no", '{"resolved": ["r1"'])
    assert ids == [["r1", "r2"], [], [], [], []]
    links = each(spark, M.link_entries, ['{"links": [{"term": "a", "target": "b"}, {"term": "", "target": "c"}, {"term": 1, "target": "d"}, {"target": "e"}, "f"]}', '{"links": 3}'])
    assert [[tuple(x) for x in r] for r in links] == [[("a", "b")], []]
