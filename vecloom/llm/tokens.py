"""Byte-level BPE encoding in Arrow batches.

Texts are cut before runs of white space and between letters and punctuation, where the tokenizer's own splitting
always has a boundary, so a chunk encodes alike wherever it stands. Each worker remembers the ids of chunks that it has seen and gives only
new ones to the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from vecloom.llm.common import cache

#: White_Space of Unicode, without the information separators that Python's white-space class has besides.
_W = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters in any Unicode version. ASCII punctuation but the apostrophe never joins the letters before it.
_A = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_P = r"!#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~" + '"'
_CHUNK = rf" ?[{_A}]++(?![^{_W}{_P}])|\n(?=[^{_W}])|[{_W}]*[^{_W}]+|[{_W}]+"
#: Chunks of a generation that a worker remembers, about 200 bytes each; there are two generations.
REMEMBERED = 550_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The printable character for each byte in the vocabulary of byte-level tokenizers: itself, or the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


class _Chunks(dict):
    """Chunk to the bytes of its ids. One of letters alone is a single piece for the model, without the steps before it.

    A full generation becomes the older one, and the one before that is dropped; chunks that occur again move on.
    """

    def __init__(self, tokenizer):
        self.encode, self.tokenize, self.older = tokenizer.encode, tokenizer.model.tokenize, {}
        self.plain, self.letters = re.compile(f" ?[{_A}]+").fullmatch, _byte_letters()
        self.space = chr(self.letters[32])

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                ids = [t.id for t in self.tokenize(self.space + chunk[1:] if chunk[0] == " " else chunk)]
            elif self.plain(chunk):
                ids = [t.id for t in self.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
            else:
                ids = self.encode(chunk, add_special_tokens=False).ids
            out = array("I", ids).tobytes()
        self[chunk] = out
        return out

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


def splits_alike(tokenizer: dict) -> bool:
    """Whether a tokenizer file is of the form whose texts may be cut in chunks: plain byte-level BPE, no normalizer, the
    usual splitting without a blank put before the text, and no added token that could lie across a cut."""
    model, before = tokenizer.get("model") or {}, tokenizer.get("pre_tokenizer") or {}
    return (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not tokenizer.get("normalizer")
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
        and all(re.fullmatch(rf"[{_P}][^{_W}]*", t["content"]) and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in tokenizer.get("added_tokens") or ())
    )


class Encoder:
    """Encodes texts as unsigned little-endian 32-bit ids. remembered: chunks of a generation.

    Tokenizers that split otherwise than splits_alike asks get whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.chunk, self.remembered, self.tokenizer = re.compile(_CHUNK), remembered, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.cuts = splits_alike(json.load(f))
        self.chunks = _Chunks(self.tokenizer)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.chunks) > self.remembered:
            self.chunks.turn()
        return b"".join(map(self.chunks.__getitem__, self.chunk.findall(text)))


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this worker process."""
    return cache(f"encoder {path} {remembered}", lambda: Encoder(path, remembered))
