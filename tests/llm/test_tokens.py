"""Tokenising against the library itself, on texts made to be awkward."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivelens.llm import tokens

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = st.text(st.sampled_from("aBzß'sé.,!1 ٣\t\n\r\x0b ́　世Σσ\U0001f600<|>"), max_size=40)
WORDS = st.lists(st.sampled_from(["the", "The", "then.", "it's", "Straße,", "ΟΔΟΣ", "a.b", "...", "", "\n", "x" * 200, "42", "<|endoftext|>", "é.", "é,"]), max_size=12).map(" ".join)


@pytest.mark.parametrize(("name", "spaced"), FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(ODD, WORDS), max_size=6))
def test_ids_equal_the_library(name, spaced, texts):
    own = tokens.tokenizer(tokens.vocabulary_path(name), spaced)
    ids, counts = own.encode([*texts, None], 7)
    ends = np.cumsum(counts)
    for text, a, b in zip([*texts, ""], ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == [*own.library.encode(text, add_special_tokens=False).ids, 7]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    own = tokens.WordTokenizer(tokens.vocabulary_path("byte_bpe_50k.json"), True)
    texts = [f"word{i} other. {i}" for i in range(20)]
    for _ in range(3):
        ids, _ = own.encode(texts, 1)
        assert ids.tolist() == [x for t in texts for x in [*own.library.encode(t, add_special_tokens=False).ids, 1]]


@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_added_tokens_equal_a_fresh_library(name, spaced):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.vocabulary_path(name))
    own = tokens.WordTokenizer(tokens.vocabulary_path(name), spaced)
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|startoftext|>b", "a <|ENDOFTEXT|> b", "x <|endoftext |> <|", "plain words.", "é<|endoftext|>\n\n<|endoftext|> é"]
    ids, counts = own.encode(texts, 7)
    wanted = [[*fresh.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
    assert fresh.token_to_id("<|endoftext|>") in wanted[0]


def test_words_of_an_earlier_generation_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 60)
    for name, spaced in FILES:
        own = tokens.WordTokenizer(tokens.vocabulary_path(name), spaced)
        for k in range(12):
            texts = [f"common words stay. {'ab' * k} é{k}, {k}", None, f"İ{k}. common"]
            ids, _ = own.encode(texts, 1)
            assert ids.tolist() == [x for t in texts for x in [*own.library.encode(t or "", add_special_tokens=False).ids, 1]]
            assert own.past is None or own.known <= 60
        own.rest(0)
        assert own.known == 0 and own.past is None
