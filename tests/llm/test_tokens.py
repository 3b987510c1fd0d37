import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from vecloom.llm.tokens import Encoder, tokenizer_path

PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", chr(0x2028), "a", "foo", "it's", "!!", "'s", "'", "123", "é", "中文", "<|endoftext|>", "<|", "\U0001f600", "​", "﻿", "\x00", ".", "[x]", "\\", "\"", "-", "@", "́", "ǅ", "_"]


def test_chunks_encode_as_whole_texts():
    rng, whole = random.Random(1), tokenizers.Tokenizer.from_file(tokenizer_path())
    ours = Encoder(tokenizer_path(), remembered=500)
    texts = ["", None, *("".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(20_000))]
    for text, ids in zip(texts, (e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False))):
        assert memoryview(ours.encode(text)).cast("I").tolist() == ids if ids else ours.encode(text) == b"", repr(text)


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A blank before the text, another splitting, lower case, added tokens with blanks: the library's ids all the same."""
    import json

    own = json.load(open(tokenizer_path()))
    other = {
        "prefix": own | {"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": own | {"normalizer": {"type": "Lowercase"}}, "cut": own | {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
        "token": own | {"added_tokens": [*own["added_tokens"], {"id": 50257, "content": "foo bar", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]},
    }
    rng, files = random.Random(2), {k: tmp_path / f"{k}.json" for k in other}
    for k, x in other.items():
        files[k].write_text(json.dumps(x))
    texts = [" ".join(rng.choices([*PARTS, "Foo", "bar", "foo bar"], k=rng.randint(1, 9))) for _ in range(400)]
    for path in [*map(str, files.values()), tokenizer_path("word_bpe_49k.json")]:
        whole = tokenizers.Tokenizer.from_file(path)
        whole.no_truncation()
        ours = Encoder(path)
        assert ours.cuts == path.endswith("cut.json")
        for t in texts:
            assert memoryview(ours.encode(t)).cast("I").tolist() == whole.encode(t, add_special_tokens=False).ids, (path, t)
