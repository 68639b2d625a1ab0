import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n_words string, component long, key int"


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, test items, licenses, nulls, empty and very long texts, and clashing extra columns."""
    rng = random.Random(1)
    en = [f"{a}{b}" for a in ("th", "wh", "an", "re", "on", "er", "in") for b in ("e", "ing", "ed", "at", "or", "ou", "ly")]
    fr = [f"{a}{b}" for a in ("é", "le", "qu", "ou", "è", "ai", "eau") for b in ("x", "ment", "re", "tion", "ç", "ier", "pa")]
    texts = [(prose(rng, rng.randint(20, 200), fr if k % 3 == 0 else en), "fr" if k % 3 == 0 else "en") for k in range(60)]
    base = texts[1][0].split()
    texts += [(" ".join(base), "en")] * 5
    for k in range(12):
        near = base[:]
        near[rng.randrange(len(near))] = f"edit{k}"
        texts.append((" ".join(near), "en"))
    texts += [
        (None, "en"), (None, None), ("", "en"), ("  \n\t ", None), ("12 !!", "en"), ("one two", "fr"), ("one two", "fr"),
        (prose(rng, 30_000, en), "en"), ("x" * 200_000, None), ("Released under the MIT License.\nthe erst", "en"),
        ("Licensed under CC BY-NC 4.0.\nanother line", "en"), ("mit license apache license; GNU general-public LICENSE mit\nlicense", "en"),
    ]
    rows = [(k, t, lang, f"src{k % 3}", 0 if t is None else len(t), "clash", k, 1) for k, (t, lang) in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
