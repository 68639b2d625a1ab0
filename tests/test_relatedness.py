"""The most relevant pages of each page against all pairs, on graphs with hubs, ties, isolated pages and odd types."""

import math
import random
from collections import defaultdict

import pytest

from lexaloom.operators import relatedness
from lexaloom.operators.graph import AFFINITY, TYPES

REF = "id long, type string"


def brute(nodes, edges, related, sources, k):
    kinds = dict(nodes)
    near, degree = defaultdict(set), defaultdict(int)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
        degree[a] += 1
        degree[b] += 1
    for a, b in related:
        near[a].add(b)
    of = defaultdict(set)
    for a, s in sources:
        of[a].add(s)
    out = {}
    for a in kinds:
        rows = []
        for b in kinds:
            if a == b:
                continue
            v = 3 * (((a, b) in edges) + ((b, a) in edges)) + 4.5 * (((a, b) in related) + ((b, a) in related)) + 4 * len(of[a] & of[b])
            v += sum(1.5 / math.log(max(degree[n], 2)) for n in near[a] & near[b])
            x, y = kinds[a], kinds[b]
            v += AFFINITY[TYPES.index(x)][TYPES.index(y)] if x in TYPES and y in TYPES else 0.5
            rows.append((-round(v, 6), b))
        out[a] = [(b, -v) for v, b in sorted(rows)[:k]]
    return out


def check(spark, nodes, edges, related, sources, k, hub):
    frame = lambda rows, ddl: spark.createDataFrame(sorted(rows, key=str), ddl)
    got = defaultdict(list)
    args = frame(nodes, REF), frame(edges, "src long, dst long"), frame(related, "src long, dst long"), frame(sources, "id long, source string")
    for r in relatedness.related_pages(*args, k=k, hub=hub).orderBy("node", "rank").collect():
        got[r["node"]].append((r["other"], r["relevance"]))
    want = brute(nodes, set(edges), set(related), sources, k)
    for a in want:
        assert [b for b, _ in got[a]] == [b for b, _ in want[a]], (a, got[a], want[a])
        assert [v for _, v in got[a]] == pytest.approx([v for _, v in want[a]], abs=2e-6)
    assert {a for a in got if got[a]} == {a for a in want if want[a]}


@pytest.mark.parametrize("seed,hub,k", [(1, 2, 3), (2, 4, 5), (3, 1000, 4)])
def test_against_all_pairs(spark, seed, hub, k):
    rng = random.Random(seed)
    n = 70
    nodes = [(a, rng.choice([*TYPES, "other", None])) for a in range(n)]
    edges = {(a, b) for _ in range(60) if (a := rng.randrange(n)) != (b := rng.choice([0, 1, rng.randrange(n)]))}
    related = {(a, b) for _ in range(15) if (a := rng.randrange(n)) != (b := rng.randrange(n))}
    sources = {(a, s) for a in range(n - 8) for s in rng.sample(["s0"] * 6 + ["s1"] * 4 + ["s2"] * 3 + [f"r{k}" for k in range(9)], rng.randint(0, 5))}
    check(spark, nodes, edges, related, sources, k, hub)


def test_few_and_no_pages(spark):
    check(spark, [(1, "entity")], set(), set(), {(1, "s")}, 3, 2)
    check(spark, [(1, "entity"), (2, "query"), (3, None)], {(1, 2), (2, 1)}, {(3, 1)}, {(1, "s"), (2, "s"), (3, "s")}, 5, 2)
    empty = spark.createDataFrame([], REF)
    pairs, sources = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "id long, source string")
    assert relatedness.related_pages(empty, pairs, pairs, sources).count() == 0


def test_a_hub_is_not_expanded(spark):
    """All pages share one source and a third another: classes are three, so the joined rows do not grow with the pages."""
    made = {}
    for n in (300, 1200):
        about = spark.createDataFrame(
            [(a, "entity", [(("source", "x"), 4.0)] + ([(("source", "y"), 4.0)] if a % 3 == 0 else [])) for a in range(n)],
            "id long, type string, hubs array<struct<feature:struct<kind:string,key:string>,weight:double>>",
        )
        floor = spark.createDataFrame([], "id long, floor double")
        classes, best = relatedness._by_hubs(about, floor, 3)
        made[n] = (classes.count(), best.count())
    assert made[300] == made[1200] == (2, 8)
