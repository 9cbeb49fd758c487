"""Texts that quote an added token, against the tokenizer's file as it is loaded."""

import public_tokenizers
from tokenizers import Tokenizer

from loomspark.llm import packing


def test_quoted_added_token_has_its_id():
    read, fresh = packing.IdReader(), Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    quoted = list(fresh.get_added_tokens_decoder().items())
    assert quoted
    for i, token in quoted:
        for text in (token.content, f"one {token.content} two", f"é\n{token.content}{token.content}!", f"日本{token.content}"):
            want = fresh.encode(text, add_special_tokens=False).ids
            assert i in want and read(text).tolist() == want and read.count(text) == len(want)
    for text in ("", "plain words", "<|endoftext", "it's 12 ½"):
        assert read(text).tolist() == fresh.encode(text, add_special_tokens=False).ids
