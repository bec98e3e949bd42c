"""Ids put together from words against the tokenizer on whole texts."""

from __future__ import annotations

import sys

import numpy as np
import pytest

from scorewright.llm import token_store
from scorewright.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def whole(tokenizer, texts):
    found = tokenizer.encode_batch(list(texts), add_special_tokens=False)
    return [np.array(one.ids, "<u4").tobytes() for one in found]


def put_together(texts):
    return list(token_store.WordIds(vocabulary()).texts([text.encode() for text in texts]))


@pytest.mark.parametrize("form", ["ab{}.", "{}-", "x{}{}?!", "{}abc,", "a.{}"])
def test_all_letters_before_punctuation(tokenizer, form):
    """Letters that end in a mark once normalised, special cases of case, and all the others."""
    letters = [chr(c) for c in range(0x80, sys.maxunicode + 1) if chr(c).isalpha() and not 0x3400 <= c <= 0x9FFF and not 0xAC00 <= c <= 0xD7A3]
    texts = [form.replace("{}", letter) for letter in letters] + [form.replace("{}", c) for c in "㐀龥가힣"]
    assert put_together(texts) == whole(tokenizer, texts)


@pytest.mark.parametrize("cached", [token_store.CACHED_WORDS, 3])
def test_texts_in_any_company(tokenizer, monkeypatch, cached):
    monkeypatch.setattr(token_store, "CACHED_WORDS", cached)
    monkeypatch.setattr(token_store, "TEXT_BYTES", 200)
    rng = np.random.default_rng(6)
    bits = ["a", "Ab", "don't", "I'll", "1", "²", "İ", "क़", "ড়", "é", "é", "ß", "ﬁ", "Σ", "ς", ".", ",", "--", "<|endoftext|>", "<", "|>", " ", "  ", "\t", "\n", " ", " ", "日本", "🙂", "́", "_", "'s"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(3000)] + ["", " ", "word " * 500]
    assert put_together(texts) == whole(tokenizer, texts)


def test_plain_words_go_to_the_model_alone(tokenizer, monkeypatch):
    """Words of plain letters, in either case and before punctuation, cost the whole tokenizer nothing."""
    rng = np.random.default_rng(7)
    letters = [letter.decode() for letter in sorted(token_store.PLAIN)] + list("abcdeEThion") * 30
    words = ["".join(rng.choice(letters, int(rng.integers(1, 14)))) + str(rng.choice(["", "", ".", ",", "!?"])) for _ in range(20_000)]
    texts = [" ".join(words[at : at + 40]) for at in range(0, len(words), 40)]
    want, ids = whole(tokenizer, texts), token_store.WordIds(vocabulary())
    asked = []

    class Watched:
        def encode_batch_fast(self, parts, **options):
            asked.extend(parts)
            return tokenizer.encode_batch_fast(parts, **options)

    monkeypatch.setattr(ids, "_tokenizer", Watched())
    assert list(ids.texts([text.encode() for text in texts])) == want
    assert set(asked) <= {".", ",", "!?"}
