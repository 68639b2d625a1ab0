"""The link pass: cases of each rule, and random pages against a search that looks for every term at every place."""

import random
import re

import pytest

from lexaloom.operators import linking


def brute(content, targets, own, most):
    """The rules word by word: leftmost, then longest, then smallest slug; every target once."""
    front = re.match(r"---\n.*?\n---\n", content, re.S)
    start = front.end() if front else 0
    terms = {(s.strip(), t.strip()) for s, title in targets for t in (s, title or "") if s.lower() not in (own.lower(), *linking.STRUCTURAL)}
    cjk = lambda t: any("㐀" <= c <= "鿿" or "ぁ" <= c <= "ヿ" or "가" <= c <= "힣" for c in t)
    terms = {(s, t) for s, t in terms if len(re.sub(r"\s", "", t)) >= (2 if cjk(t) else 3)}
    out, linked, added = content[:start], set(), 0
    parts = re.split(r"(```[\s\S]*?```|`[^`\n]+`|\[\[[^\]\n]+\]\])", content[start:])
    for k, seg in enumerate(parts):
        at = 0
        while k % 2 == 0 and at < len(seg) and added < most:
            here = []
            for s, t in terms:
                end = at + len(t)
                whole = cjk(t) or not (at and seg[at - 1].isalnum()) and not (end < len(seg) and seg[end].isalnum())
                if seg[at:end].lower() == t.lower() and whole and s.lower() not in linked:
                    here.append((-len(t), s))
            if here:
                size, slug = min(here)
                shown = seg[at : at - size]
                out += f"[[{slug}]]" if shown == slug else f"[[{slug}|{shown}]]"
                linked.add(slug.lower())
                added, at = added + 1, at - size
            else:
                out, at = out + seg[at], at + 1
        out += seg[at:]
    return out, added


def passed(spark, pages, targets, most=15):
    p = spark.createDataFrame([(k, t, "x") for k, t in pages], "path string, content string, terms string").repartition(3)
    t = spark.createDataFrame(targets, "slug string, title string")
    return {r["path"]: (r["content"], r["n_added"]) for r in linking.link_pages(p, t, most).collect()}


CASES = [
    ("---\ntitle: Intro\n---\n\nTransformer models use attention mechanism heavily.", [("transformer", "Transformer"), ("attention-mechanism", "attention mechanism")], 15,
     "---\ntitle: Intro\n---\n\n[[transformer|Transformer]] models use [[attention-mechanism|attention mechanism]] heavily.", 2),
    ("---\nsummary: attention mechanism\n---\n```md\nattention mechanism\n```\n`attention mechanism` and [[transformer]].\nOutside attention mechanism once, attention mechanism.", [("attention-mechanism", "attention mechanism")], 15,
     "---\nsummary: attention mechanism\n---\n```md\nattention mechanism\n```\n`attention mechanism` and [[transformer]].\nOutside [[attention-mechanism|attention mechanism]] once, attention mechanism.", 1),
    ("Partial artifact appears in artificial systems.", [("art", "art"), ("ai", "AI")], 15, "Partial artifact appears in artificial systems.", 0),
    ("Graph neural network methods are common.", [("graph", "Graph"), ("graph-neural-network", "Graph neural network")], 15, "[[graph-neural-network|Graph neural network]] methods are common.", 1),
    ("Alpha Beta Gamma Delta", [("alpha", "Alpha"), ("beta", "Beta"), ("gamma", "Gamma"), ("delta", "Delta")], 2, "[[alpha|Alpha]] [[beta|Beta]] Gamma Delta", 2),
    ("我们使用注意力机制和模型", [("attention", "注意力机制"), ("zhu", "注意"), ("m", "模型")], 15, "我们使用[[attention|注意力机制]]和[[m|模型]]", 2),
    ("See self and Index and log, +++ and c++ here, spark", [("self", "Self"), ("index", "Index"), ("plus", "+++"), ("cpp", "c++"), ("spark", None)], 15,
     "See self and Index and log, [[plus|+++]] and [[cpp|c++]] here, [[spark]]", 3),
]


@pytest.mark.parametrize("content,targets,most,want,n", CASES)
def test_rules(content, targets, most, want, n):
    terms = [(s, t) for s, title in targets for t in (s, title) if t and s not in linking.STRUCTURAL and len(t) >= (2 if linking._HAS_CJK.search(t) else 3)]
    assert linking.link_text(content, terms, "self", most) == (want, n) == brute(content, targets, "self", most)


def test_pages_meet_their_terms(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "beta-gamma", "İx", "c++", "注意", "机制", "x1", "Graph", "neural", "network", "the", "a", "log", "`code alpha`", "[[Graph|g]]", "\n", "```\nbeta\n```", "...", "naïve"]
    targets = [("graph", "Graph"), ("gnn", "Graph neural network"), ("nn", "neural network"), ("beta", "Beta"), ("bg", "beta-gamma"), ("zz", "注意机制"), ("zy", "机制"), ("log", "Log"),
               ("alpha", "Alpha Beta"), ("naive", "naïve the"), ("dup-a", "the graph"), ("dup-b", "the graph"), ("p7", "alpha"), ("cpp", "c++"), ("dots", "..."), ("", "empty"), ("none", None)]
    pages = [(f"wiki/p{k}.md", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(80)]
    pages += [("wiki/null.md", None), ("wiki/graph.md", "Graph graph neural network"), ("front.md", "---\ntitle: Graph\n---\nGraph"), ("wiki/long.md", "the graph " * 5000)]
    got = passed(spark, pages, targets, 4)
    for path, content in pages:
        own = re.sub(r"\.md$", "", path.rsplit("/", 1)[-1])
        assert got[path] == ((None, 0) if content is None else brute(content, [t for t in targets if t[0]], own, 4)), path
    assert passed(spark, pages[:2], []) == {p: (c, 0) for p, c in pages[:2]}
    assert passed(spark, [], targets) == {}
