"""Texts that hold an added token's string, against a tokenizer as the library loads it."""

from tokenizers import Tokenizer

from edgeloom.llm import encoding


def test_added_tokens_are_encoded_as_by_a_fresh_library():
    path = encoding.default_tokenizer()
    enc, fresh = encoding.Encoder(path), Tokenizer.from_file(path)
    for t in ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", "plain text  here"]:
        assert enc.ids(t).tolist() == fresh.encode(t, add_special_tokens=False).ids
