"""Line rules, token alignment and the filter audit against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from lexaloom.llm import alignment, filter_audit, line_rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_align(tok, model, text):
    """Groups as pairs of id lists, by intersecting the sets of end offsets; None without tokens."""
    if not text:
        return None
    whole = b" " + text.encode()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    from public_tokenizers import path
    from tokenizers import Tokenizer

    vocab = {i: t for t, i in Tokenizer.from_file(path("byte_bpe_50k.json")).get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    bytes_a = [bytes(of[c] for c in vocab[i]) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends = [list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
    both = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for e in both:
        x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


HARD = [
    "a  b   c    d", " lead", "  two", "tail ", "tail  ", "\n\nx\n y\t z", "a<s>b </s> <unk> <0x41>", "<|endoftext|> x <|endoftext|>", "a▁b", "▁", "ﬁ é́ ①", "😀 👩‍👩‍👧 \x00 \x01",
    "漢字 かな 한국어 ไทย", "don't I'll we've", "x" * 3000, "1234567890 3.14 1e9", "naïve café ÀÉ ß", "\u00a0x \u2003y", "ab\r\ncd", "word, word; (word) [word] {word}", "A B C", ".", " ", "   ",
    "\ue000 \uffff x", "e\u0301 a\u0300", "'s 't", "  \n  \n", "-- --- ----", "#!/bin/sh\nfor i in 1 2 3; do echo $i; done",
]


def test_alignment(docs, corpus, no_docs, spark, tokenizer):
    from public_tokenizers import path
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok, model = Tokenizer.from_file(tokenizer), SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    tok.encode_special_tokens = True
    rng = random.Random(5)
    texts = [(k, t) for k, t, *_ in corpus] + list(enumerate(HARD, 1000)) + [(2000 + k, " ".join(rng.choices(HARD, k=4))) for k in range(150)] + [(None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, Link int").repartition(3)
    groups = [(k, brute_align(tok, model, t)) for k, t in texts]
    assert sum(g is None for _, g in groups) > 5
    counts = Counter((a[-1], b[-1]) for _, g in groups if g for a, b in g)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for k, g in groups:
        if g is None:
            want.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in g]
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest()
        want.append((k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    got = [tuple(r) for r in alignment.cross_align(df, tokenizer, path("piece_bpe_32k.model")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert alignment.cross_align(no_docs, tokenizer, path("piece_bpe_32k.model")).count() == 0


def test_diagonal_runs():
    """Made end arrays with long one-to-one runs and shifts between them, against intersection."""
    rng = random.Random(3)
    for _ in range(300):
        a, b, at = [], [], 0
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.choice((0, 1, 2, 7, 100))):
                at += rng.randint(1, 4)
                a.append(at)
                b.append(at)
            stop = at + rng.randint(3, 9)
            a += sorted(rng.sample(range(at + 1, stop), rng.randint(0, 2))) + [stop]
            b += sorted(rng.sample(range(at + 1, stop), rng.randint(0, 2))) + [stop]
            at = stop
        both = sorted(set(a) & set(b))
        last_a, last_b = alignment.spread(*alignment.align(a, b))
        assert (last_a.tolist(), last_b.tolist()) == ([a.index(e) for e in both], [b.index(e) for e in both])


def test_pairs_are_bounded_by_the_vocabularies(tokenizer):
    made = alignment.Pair(tokenizer, __import__("public_tokenizers").path("piece_bpe_32k.model"))
    most = alignment.most_pairs(made.bytes_a, made.bytes_b)
    assert 50_000 < most < 2_000_000
    assert alignment.most_pairs([b"ab", b"b"], [b"b", b"ab", b"c"]) == 4


def brute_line(text):
    ws = words(text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    own = list(dict.fromkeys(lines))

    def fails(x):
        chars = sum(map(len, words(x)))
        marks = sum(c in line_rules.SEPARATORS for c in x)
        if marks >= 2 and 4 * marks >= len(words(x)) or 10 * sum(c in line_rules.SYMBOLS for c in x) > chars:
            return True
        if len(x) >= line_rules.SHORT:
            return False
        low = x.lower()
        menu = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if w]
        ended = any(re.search(r"""[.!?…。！？]["'”’»)\]]*$""", w) for w in words(x))
        return not ended or bool(menu) and set(menu) <= set(line_rules.MENU_WORDS) or any(p in low for p in line_rules.PHRASES)

    left = [x for x in own if not fails(x)]
    chars, kept_chars = sum(map(len, ws)), sum(len(w) for x in left for w in words(x))
    base = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return (
        len(ws), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(own), len(hit), base,
        not base and 100 * (chars - kept_chars) <= line_rules.LOST_PERCENT * chars, len(lines), len(left), kept_chars,
    ), "\n".join(left)


def line_texts():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(40)) for _ in range(n))
    prose = [f"{say(12)}. {say(9)}!\n{say(25)}." for _ in range(6)]
    phrase = "one two three four five six"
    return [
        *prose, None, "", " \n\t\n", "word", "nine words are not enough for this rule so.",
        f"{prose[0]}\nHome | About | Contact | Login", f"{prose[0]}\nhome about us contact\n\nWe use cookies.\nShare this.", f"{prose[1]}\n{prose[1]}\n{prose[1]}",
        f"{say(30)} {phrase} {say(5)} {phrase} {say(5)} {phrase}.", f"{phrase} {phrase} {phrase} {phrase}", "a b c d e a b c d e a b c d e", "a b c d e f g h i j",
        " ".join(f"w{k % 7}###" for k in range(50)), "no end here\n" * 4 + say(15) + ".", say(60), f"  {say(12)}.  \r\n{say(12)}?\r\n", f"{say(11)}.\x0b{say(3)}\x0c",
        "漢字 " * 20 + "。", "Menu » Start » Mehr\n" + say(20) + ".", say(20_000) + ".", f"Éçê in\n{say(20)}.", "x" * 250 + "\n" + say(20) + ".",
    ]


def test_line_rules(spark, docs, corpus, no_docs):
    rows = [(k, t, "c", 1) for k, t in enumerate(line_texts())]
    rows += [rows[0], (None, rows[1][1], "d", 2)] + [(1000 + k, t, "e", 3) for k, t, *_ in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string, n int").repartition(3)
    got = sorted((tuple(r) for r in line_rules.judge(df).collect()), key=str)
    assert got == sorted(((k, *brute_line(t)[0]) for k, t, *_ in rows), key=str)
    assert sum(r[7] for r in got) > 10 and len({r[6:8] for r in got}) >= 3
    left = line_rules.clean(df)
    assert left.columns == df.columns
    want = [(k, brute_line(t)[1]) for k, t, *_ in rows if brute_line(t)[0][6]]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)
    assert line_rules.judge(no_docs).count() == 0 and line_rules.clean(no_docs).count() == 0


def test_repeated_windows_whose_hashes_meet(spark, monkeypatch):
    """With hashes of no bits all windows meet, and the words alone tell them apart."""
    plain = re.sub(r"xxhash64\([^)]*\)", "0L", line_rules._repeats())
    assert plain != line_rules._repeats()
    monkeypatch.setattr(line_rules, "_repeats", lambda: plain)
    texts = [t for t in line_texts() if t is None or len(t) < 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in line_rules.judge(df).collect()} == {k: brute_line(t)[0][4] for k, t in enumerate(texts)}


def test_line_rules_stay_in_the_engine(docs):
    plan = line_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]


def brute_audit(rows, labels):
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    good, bad = ({k for k, q, x in labels if (q, x)[n] == 1 and k is not None} for n in (0, 1))
    marked = []
    for k, t, s in rows:
        t = t or ""
        ws = words(t)
        fails = "".join(
            c for c, f in zip("ABCDE", (
                len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                k is not None and k > first.get(t, k),
            )) if f
        )
        marked.append((s or "", fails, k in good, k in bad))
    out, shapley = [], Counter()
    for part in {m[0] for m in marked}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                own, before = [m for m in marked if m[0] == part], set(order[: step - 1])
                gone = [m for m in own if c in m[1] and not before & set(m[1])]
                shapley[part, c] += len(gone)
                out.append((
                    part, order, step, sum(not set(order[:step]) & set(m[1]) for m in own), len(gone), sum(c in m[1] and bool(before & set(m[1])) for m in own),
                    sum(m[1] == c for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone),
                ))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark, docs, corpus, no_docs):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(k, t, s) for k, t, _, s, *_ in corpus] + [
        (500, long, "src0"), (501, long, "src1"), (500, long, "src0"), (None, long, "src1"), (None, long, None), (502, long + " #", None), (503, long.upper(), ""),
        (504, "a b " * 40, "src9"), (505, "A B " * 40 + "$", "src9"), (506, None, "src9"), (507, "", "src9"), (499, "x y\tz", "src9"),
    ]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 90, 2)] + [(500, 1, 0), (501, 1, 1), (501, 0, None), (None, 1, 1), (504, None, 1), (505, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, `key` string").repartition(3)
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(df, own).collect())
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    assert filter_audit.audit(no_docs, own).count() == 0
    assert filter_audit.audit(df, own.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("letters", ["A", "AB", "ABC"])
def test_walk_has_every_prefix(spark, letters):
    masks = spark.range(1 << len(letters)).selectExpr("cast(id AS int) AS mask")
    got = Counter(r["prefix"] for r in filter_audit.walk(masks, letters).collect())
    want = ["".join(p) for n in range(1, len(letters) + 1) for p in itertools.permutations(letters, n)]
    assert got == Counter({p: 1 << len(letters) for p in want})
