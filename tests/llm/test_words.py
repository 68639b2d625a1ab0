"""Words that the tokenizer's model takes in groups, new ones and those of both generations that are kept."""

import random

from lexaloom.llm import tokens


def test_words_in_groups(tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(tokenizer), tokens.Encoder(tokenizer)
    monkeypatch.setattr(tokens, "MODEL_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_UNITS", 40)
    rng, held = random.Random(5), []
    tokenize = enc.model.tokenize
    enc.model = type("Model", (), {"tokenize": staticmethod(lambda w: held.append(w) or tokenize(w))})
    words = ["".join(rng.choice("abcdeéñßÅZq") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["w" * 200]
    for _ in range(6):
        texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "\n" + rng.choice(words), "...\n" + rng.choice(words) + "!"]) for _ in range(rng.randrange(40))) for _ in range(20)]
        assert [x.tolist() for x in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    short = [w for w in held if len(w) < 100]
    assert len(short) > 60 and len(short) < 6 * len(set(short)), "words are kept between calls"
