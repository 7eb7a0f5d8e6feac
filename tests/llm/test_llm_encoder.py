"""The cached encoder's work and results."""

from __future__ import annotations

import random
from functools import partial

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewright.llm.bpe import CachedEncoder, tokenizer_file
from tracewright.llm.wavelet import encode_words


class Counted(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def encoder(library):
    return CachedEncoder(partial(encode_words, library.model), {x.content: i for i, x in library.get_added_tokens_decoder().items()})


def test_a_piece_is_asked_for_once_a_call(library):
    own = encoder(library)
    own.after = Counted()
    own(["begin" + " word other" * 5_000] * 4)
    assert own.after.asked < 20


def test_odd_texts_as_the_library(library):
    own, pick = encoder(library), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "'s", "1", ",", "!", "\t", *list(own.added)[:2], " the", " x", "."]
    texts = ["".join(pick.choices(parts, k=pick.randrange(30))) for _ in range(2_000)] + ["", " ", "  ", "a ", " a", "a" * 100]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert own(texts) == want
    assert [own([t])[0] for t in texts[-50:]] == want[-50:]
    assert own([]) == []
