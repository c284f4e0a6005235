"""Operator 3: BPE encoding as a bounded-lookahead streaming transducer, and decoding.

Encoding. The merge list decides how far a text can act back on what stands before.
:func:`reaches` computes for each token how many bytes after its end can still move
that end; the largest of them is the list's sufficient lookahead. Text is fed in
chunks. Inside a pre-token, ids are emitted up to the last token whose reach is
covered by bytes already seen, or up to a boundary that no token of the vocabulary
spans, and the rest when the pre-token's end is seen. Every id of every text comes
out of these two steps (:meth:`Encoder._grow`, :meth:`Encoder._end`); a memo keeps
what they emitted for whole pre-tokens. What is held between chunks is bounded by the
lookahead and the longest token, whatever the script and however long an unbroken
run is; only a run of combining marks is held until its end, as normalisation must
see it whole.

Decoding. A state machine takes ids one chunk at a time. With a tokenizer file
that has no decoder, tokens are joined by one space; in byte mode, tokens become
bytes (word ends become spaces) and an incremental UTF-8 decoder holds back an
incomplete character until its last byte comes.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map
from granary.llm.pieces import byte_chars

#: Pre-token pattern and word-end mark of the tokenizer file (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
WORD_END = "</w>"

CHUNK_CHARS = 1 << 16
#: Symbols taken at a time into an open pre-token.
STEP = 128
MEMO_ENTRIES = 500_000


def reaches(merges: list[tuple[str, str]], length=lambda t: len(t.removesuffix(WORD_END))) -> dict[str, int]:
    """For each token, how many bytes after its end can still move that end.

    A merge (t, v) takes the end of t away, and needs v whole: v's length and what
    can act on v's end in turn. A token made of two inherits the reach of its right
    part, which ended where it ends. Merges act in rank order, so one pass in that
    order sees each reach as it is when the merge acts.
    """
    reach: dict[str, int] = defaultdict(int)
    for left, right in merges:
        ahead = reach[right]
        reach[left] = max(reach[left], length(right) + ahead)
        reach[left + right] = max(reach[left + right], ahead)
    return dict(reach)


def lookahead(merges: list[tuple[str, str]], **length) -> int:
    """The merge list's sufficient lookahead in bytes: the largest reach."""
    return max(reaches(merges, **length).values(), default=0)


@lru_cache(maxsize=1)
def joiners() -> frozenset[str]:
    """Characters that normalisation may join to, or move across, the one before."""
    second = {int(x, 16) for c in map(chr, range(sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and d[0] != "<" for x in d.split()[1:]}
    vowels_and_finals = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # of conjoining jamo
    return frozenset(map(chr, second | vowels_and_finals))


def starts_anew(c: str) -> bool:
    """Whether text from ``c`` on normalises independently of what stands before."""
    return c < "\u0300" or not (unicodedata.combining(c) or c in joiners())


class Merges:
    """Vocabulary, merge ranks and the sufficient lookahead of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pairs: dict[str, dict[str, tuple[int, str]]] = defaultdict(dict)
        for rank, (a, b) in enumerate(pairs):
            self.pairs[a][b] = (rank, a + b)
        self.reach = reaches(pairs)
        self.ahead = max(self.reach.values(), default=0)
        #: Neighbours inside some token; between any other two symbols a token ends.
        self.inside = {x for t in self.vocab for x in zip(t.removesuffix(WORD_END), t.removesuffix(WORD_END)[1:])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.joined = spec.get("decoder") is None
        self.byte = byte_chars()

    def symbols(self, piece: str) -> list[str]:
        return [self.byte[b] for b in piece.encode("utf-8")]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        pairs = self.pairs
        none: dict = {}
        while len(symbols) > 1:
            best = None
            before = symbols[0]
            for after in symbols[1:]:
                got = pairs.get(before, none).get(after)
                if got is not None and (best is None or got < best[0]):
                    best = (got, before, after)
                before = after
            if best is None:
                break
            (_, both), a, b = best
            out, i, n = [], 0, len(symbols)
            while i < n:
                if i + 1 < n and symbols[i] == a and symbols[i + 1] == b:
                    out.append(both)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols


class Encoder:
    """feed(text) and close() return ids as soon as they are certain.

    ``ahead_ids`` counts the ids emitted inside a pre-token, before its end was seen.
    """

    def __init__(self, merges: Merges):
        import regex

        self.m = merges
        self.pieces = regex.compile(PATTERN).finditer
        self.letter = regex.compile(r"\p{L}").match
        self.runs = {True: regex.compile(r"\p{L}*").match, False: regex.compile(r"[^\s\p{L}\p{N}]*").match}
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special)))) if merges.special else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.parts = _Parts(merges)
        self.words = _Words(self)
        self.ahead_ids = 0
        self._reset()

    def _reset(self) -> None:
        self.raw = ""  # text that is not normalised yet
        self.held = ""  # normalised text of which it is not known where its pre-token ends: a contraction's first characters
        self.open: list[str] | None = None  # symbols of an unended pre-token that are not emitted yet
        self.letters = False  # whether that pre-token is one of letters

    def kept(self) -> int:
        """Characters and symbols held at the moment."""
        return len(self.raw) + len(self.held) + len(self.open or ())

    def word(self, piece: str) -> tuple[int, ...]:
        """ids of one whole pre-token."""
        got = self.memo.get(piece)
        if got is None:
            self.open = []
            got = (*self._grow(self.m.symbols(piece)), *self._end())
            if len(self.memo) < MEMO_ENTRIES and len(piece) < 64:
                self.memo[piece] = got
        return got

    def _grow(self, symbols: list[str]) -> list[int]:
        """Add symbols to the open pre-token; emit what no later byte can change."""
        out: list[int] = []
        inside, reach, vocab = self.m.inside, self.m.reach, self.m.vocab
        for at in range(0, len(symbols), STEP):
            known = self.open + symbols[at : at + STEP]
            start = 0
            for i, pair in enumerate(zip(known, known[1:]), 1):
                if pair not in inside:
                    out += self.parts["".join(known[start:i])]
                    start = i
            known = known[start:]
            # The last symbol is not certain: at the pre-token's end it becomes another.
            tokens, end, used, emitted = self.m.merge(known), 0, 0, 0
            for n, token in enumerate(tokens, 1):
                end += len(token)
                if end + reach.get(token, 0) < len(known):
                    used, emitted = end, n
            out += [vocab[t] for t in tokens[:emitted]]
            self.open = known[used:]
        self.ahead_ids += len(out)
        return out

    def _end(self) -> list[int]:
        symbols, self.open = self.open, None
        symbols[-1] += WORD_END
        return [self.m.vocab[t] for t in self.m.merge(symbols)]

    def _normal(self, text: str) -> str:
        """NFC and lower case of each character for itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:
                return "".join(c.lower() for c in text)
        return text.lower()

    def _scan(self, text: str, last: bool) -> list[int]:
        """ids that are certain with more normalised text; ``last`` ends the pre-token."""
        text, out = self.held + text, []
        self.held = ""
        if self.open is not None:
            end = self.runs[self.letters](text).end()
            out += self._grow(self.m.symbols(text[:end]))
            if end == len(text) and not last:
                return out
            out += self._end()
            text = text[end:]
        cut = len(text) if last else max(text.rfind(" "), text.rfind("\n")) + 1
        out += chain.from_iterable(map(self.words.__getitem__, text[:cut].replace("\n", " ").split(" ")))
        text = text[cut:]
        for m in self.pieces(text):
            rest = text[m.start() :]
            if rest[0] == "'" and len(rest) < 3:
                self.held = rest
                break
            letters = self.letter(rest) is not None
            if m.end() == len(text) and m[0] not in CONTRACTIONS and (letters or self.runs[False](rest).end()):  # a run that may go on
                self.open, self.letters = [], letters
                out += self._grow(self.m.symbols(rest))
                break
            out += self.word(m[0])
        return out

    def _cut(self, raw: str) -> int:
        """Where text begins that a special token, or a mark after it, may yet change."""
        at = max(0, len(raw) - 1)
        for token in self.m.special:
            for n in range(min(len(token) - 1, len(raw)), 0, -1):
                if raw.endswith(token[:n]):
                    at = min(at, len(raw) - n)
                    break
        while at > 0 and not starts_anew(raw[at]):
            at -= 1
        return at

    def feed(self, text: str) -> list[int]:
        """ids that are certain with this chunk."""
        raw, out, at = self.raw + text, [], 0
        for m in self.special.finditer(raw) if self.special else ():
            out += [*self._scan(self._normal(raw[at : m.start()]), True), self.m.special[m[0]]]
            at = m.end()
        raw = raw[at:]
        cut = self._cut(raw)
        self.raw = raw[cut:]
        return out + self._scan(self._normal(raw[:cut]), False)

    def close(self) -> list[int]:
        """ids of what is left; the encoder can then take the next document."""
        out = self._scan(self._normal(self.raw), True)
        self._reset()
        return out

    def encode(self, text: str):
        """Lists of ids of one document."""
        for at in range(0, len(text), CHUNK_CHARS):
            yield self.feed(text[at : at + CHUNK_CHARS])
        yield self.close()


class _Words(dict):
    """Chunk of normalised text without spaces and line feeds -> ids."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        e = self.encoder
        ids = tuple(chain.from_iterable(e.word(m[0]) for m in e.pieces(chunk)))
        if len(self) < MEMO_ENTRIES and len(chunk) < 64:
            self[chunk] = ids
        return ids


class _Parts(dict):
    """Symbols between two boundaries that no token spans -> ids."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = tuple(map(self.merges.vocab.__getitem__, self.merges.merge(list(part))))
        if len(self) < MEMO_ENTRIES and len(part) < 64:
            self[part] = ids
        return ids


class Decoder:
    """feed(ids) returns text as soon as it is certain.

    ``as_bytes`` turns tokens into bytes and word ends into spaces; else the
    tokens themselves are joined as a file without decoder asks for.
    """

    def __init__(self, merges: Merges, as_bytes: bool | None = None):
        self.as_bytes = not merges.joined if as_bytes is None else as_bytes
        self.tokens = merges.tokens
        if self.as_bytes:
            byte_of = {c: b for b, c in merges.byte.items()}
            special = set(merges.special.values())
            self.bytes = {i: t.encode() if i in special else bytes(byte_of[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END) for i, t in merges.tokens.items()}
        self._reset()

    def _reset(self) -> None:
        self.begun = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if self.as_bytes:
            return self.utf8.decode(b"".join(map(self.bytes.__getitem__, ids)))
        text = " " * (self.begun and bool(ids)) + " ".join(map(self.tokens.__getitem__, ids))
        self.begun = self.begun or bool(ids)
        return text

    def close(self) -> str:
        rest = self.utf8.decode(b"", True)
        self._reset()
        return rest


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Encoder, Decoder, dict[int, str]]:
    """Kept by a Python worker from task to task, so the memo stays warm."""
    merges = Merges(path)
    return Encoder(merges), Decoder(merges), {i: str(i) for i in merges.tokens}


ROUND_TRIP = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _rows(docs: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work`` on 64 documents at a time."""

    def make():
        def run(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 64):
                rows = [(i, *work(t or "")) for i, t in zip(ids[at : at + 64], texts[at : at + 64].to_pylist(), strict=True)]
                yield dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))

        return run

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them (null text: empty)."""

    def work(text: str):
        encoder, decoder, _ = codec(path)
        ids = list(chain.from_iterable(encoder.encode(text)))
        return ids, decoder.feed(ids) + decoder.close()

    return _rows(docs, work, CODED)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Both digests are taken as ids and text come out of the two machines, so no
    document's ids are held whole. Null and empty texts have no ids and the
    digests of an empty string; repeated rows and null doc_ids are kept, other
    columns ignored, an empty table gives no rows.
    """

    def work(text: str):
        encoder, decoder, decimal = codec(path)
        ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
        for ids in encoder.encode(text):
            if ids:
                ids_sha.update((" " * bool(n) + " ".join(map(decimal.__getitem__, ids))).encode())
                text_sha.update(decoder.feed(ids).encode())
                n += len(ids)
        text_sha.update(decoder.close().encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    return _rows(docs, work, ROUND_TRIP)
