"""The memory of units: ids by units equal those of whole texts, also once the memory is full."""

import pytest

from verisift.llm.queries import tokenizer_path
from verisift.llm.tokens import coder, encode_texts

TEXTS = ["", "one two  three", " lead and trail ", "a b c", "tab\t end\n", "x<|endoftext|> y <|endoftext|>", "café 世界 \U0001f600 it's", "one two three", "\n", " ", "z" * 3000 + " z", "a \x1c b"]


@pytest.mark.parametrize("limit", [0, 4, 10_000])
@pytest.mark.parametrize("kind", ["pairs", "library"])
def test_units_equal_whole_texts(kind, limit):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    coder.cache_clear()
    whole = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in TEXTS]
    for _ in range(2):
        for texts, want in ((TEXTS[:5], whole[:5]), (TEXTS[5:], whole[5:]), (TEXTS * 40, whole * 40)):
            found = encode_texts(kind, path, texts, lambda _, ids: [int(i) for i in ids], limit)
            assert [[i for u in units for i in u] for units in found] == want
    assert sum(map(len, coder(kind, path)[1:])) <= limit
    coder.cache_clear()
