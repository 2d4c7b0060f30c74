"""Token ids of whole texts by a public word-level BPE file, fast enough for a corpus.

The file's normaliser and splitter never join text across white space, so a text's ids
are its white-space-separated words' ids in order. Each worker keeps a bounded
dictionary of words it has met; new words go through the file's own splitter
pattern and its BPE model. Texts with a character beyond U+024F, or one that
Python and the tokenizer's pattern language class differently, take the whole tokenizer
instead; tests hold both ways against each other.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import regex

# The splitter pattern of the tokenizer file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD = re.compile(r"[^\x00-\x1b\x20-\u024f]")
CACHE_WORDS = 500_000


def default_tokenizer() -> str:
    """Path of the public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _ByteText(dict):
    """Character code to its UTF-8 bytes in the byte-level alphabet, for ``str.translate``."""

    def __init__(self) -> None:
        super().__init__()
        self.chars = _byte_chars()

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self.chars[b] for b in chr(code).encode())
        return out


class _Words(dict):
    """Word to the bytes of its ids, little-endian 32-bit; fills itself."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.model, self.split = tokenizer.model, regex.compile(SPLIT).findall
        self.table = _ByteText()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = [t.id for part in self.split(word) for t in self.model.tokenize(part.translate(self.table))]
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.words = _Words(self.full)

    def id_bytes(self, text: str) -> bytes:
        """The ids of ``text`` without special tokens, as little-endian unsigned 32-bit numbers."""
        if not ODD.search(text) and not any(s in text for s in self.special):
            words = self.words
            return b"".join([words[w] for w in text.lower().split()])
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
