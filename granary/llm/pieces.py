"""Memoised tokenising with public tokenizer files.

Texts made only of printable ASCII, line feeds and Latin-1 letters and signs are
cut at spaces and each chunk's ids are remembered, since neither tokenizer here
has a token that spans a chunk boundary. All other texts go to the tokenizers
library as they are. The memo has a bounded number of entries; past the bound,
chunks are encoded without being remembered.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

MEMO_ENTRIES = 500_000
#: Anything outside: the whole text takes the library's path.
UNSAFE = re.compile("[^\n\x20-\x7e¡-¬®-ÿ]")


class Memo(dict):
    """chunk -> little-endian 32-bit ids as bytes."""

    def __init__(self, encode, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(chunk)).tobytes()
        if len(self) < self.entries:
            self[chunk] = ids
        return ids


class WordTokenizer:
    """ids of a lower-casing word-end BPE (white space dropped)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        find, tokenize = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall, self.library.model.tokenize
        byte = byte_chars()

        def chunk(text: str) -> list[int]:
            return [t.id for piece in find(text) for t in tokenize("".join([byte[x] for x in piece.encode()]))]

        self.memo = Memo(chunk)

    def ids(self, text: str) -> bytes:
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.memo.__getitem__, text.lower().split()))


class ByteTokenizer:
    """ids of a byte-level BPE whose tokens carry a leading space."""

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.plain = quick.encode_ordinary
        self.memo = Memo(lambda chunk: quick.encode_ordinary(" " + chunk))

    def ids(self, text: str) -> bytes:
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if not text or "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or "\n\n" in text:
            return array("I", self.plain(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.plain(first)).tobytes() + b"".join(map(self.memo.__getitem__, rest))


def byte_chars() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte:
    itself for visible Latin-1 characters, else the next unused one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """Kept by a Python worker from task to task, so its memo stays warm."""
    return WordTokenizer(path)


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, ranks: str) -> ByteTokenizer:
    return ByteTokenizer(path, ranks)
