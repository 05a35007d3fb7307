"""Byte-level BPE ids of whole texts, from a tokenizer file given by path.

Ids are those of the tokenizers library with add_special_tokens=False. Texts without an added token of the file go
through tiktoken, built from the same file, which takes a third of the time; the others through the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern that goes with byte-level vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files: printable Latin-1 stands for itself,
    the other bytes in order for U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts; the same as of the tokenizers library with add_special_tokens=False."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        code = byte_symbols()
        ranks = {bytes(code[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        self.library, self.added = Tokenizer.from_file(path), sorted({t["content"] for t in spec.get("added_tokens", ())})
        self.fast = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "The 12 cats' naïve — «été»\n\n\t x<|endoftext|>  $%&*** 日本語  end \n"
        if self.fast.encode_ordinary(probe) != own.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level BPE of the expected pattern")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text; null: none."""
        texts = pc.fill_null(texts, "")
        held = np.zeros(len(texts), bool)
        for t in self.added:
            held |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        plain = self.fast.encode_ordinary
        whole = lambda t: self.library.encode(t, add_special_tokens=False).ids
        return [np.array(whole(t) if h else plain(t), np.uint32) for t, h in zip(texts.to_pylist(), held.tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
