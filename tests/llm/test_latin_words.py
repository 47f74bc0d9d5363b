"""Latin words go to the model as the vocabulary spells them; their ids are the library's."""

import random

import pytest

from folioscope.llm import registry
from folioscope.llm.tokens import Encoder

LETTERS = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]


@pytest.mark.parametrize("letters", [LETTERS, LETTERS[:52], LETTERS[52:]])
def test_words_have_the_ids_of_the_whole_text(letters):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    marks = ["", "", "", ".", ",", "...", '"', "'s", "\n", ".\nÀb", "1", "\u0120", "\u00ad", "\u00a0", "\u4e2d"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(marks) for _ in range(5000)]
    text = " ".join([*letters, *words, *words[:50]])
    want = Tokenizer.from_file(registry.vocabulary()).encode(text, add_special_tokens=False).ids
    encoder = Encoder(registry.vocabulary(), 700, True)
    # Once learned, once known, with generations that are too small for all.
    for _ in range(2):
        got = encoder.encode_all([text, " ".join(words[:300])])[0]
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want
