"""Operator 12: alignment of two tokenizers' ids over the same bytes.

A document's text, with a space before it, is tokenized by a byte-level BPE (A) and a
sentencepiece BPE (B). Byte offsets where tokens of both end cut them into groups, and
the two tokens that end at such an offset are linked. How often two ids are linked in
the corpus tells which id of A is the best match of each id of B.

Counts are dense matrices in stripes: B's ids are dealt to ``STRIPES`` stripes by their
remainder, and a stripe's matrix has a row for each of its ids and a column for each id
of A. Links travel as packed blocks, one for each stripe of up to ``BLOCK`` documents,
already summed by document and pair, so a frequent id sends at most one entry a
document and pair. Each (stripe, salt) adds its blocks into a matrix with ``np.add.at``;
the matrices of a stripe's salts are added one by one, their row maxima give the best
ids, and every (stripe, salt) scores the links that lie in it. There are as many salts
as keep a part's links below ``SHARE``, so no task grows with the corpus.

Edge cases: null and empty texts, and texts whose tokens do not give back their bytes,
have no tokens: zeros and an empty digest. Repeated rows and ids are documents of their
own, null ids stay null, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map, dropped, written
from granary.llm.pieces import byte_chars

STRIPES = 128
#: Documents of a block, and characters after which a block ends.
BLOCK, BLOCK_CHARS = 1024, 1 << 21
#: Links that one part of a stripe holds, on average.
SHARE = 1 << 21
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
#: Both tokenizers can be cut before a space or line feed that follows another character:
#: neither has a token that goes on over it.
CHUNKS = re.compile(r"(?:[ \n]\s*)?\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
CUT = re.compile(r"(?<=\S)(?=[ \n])")
OTHER_SPACE = re.compile(r"[^\S \n]")
SPACE_PIECE = "▁"


def byte_level_bytes(path: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level BPE."""
    from tokenizers import Tokenizer

    back = {c: b for b, c in byte_chars().items()}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return {i: bytes(back[c] for c in token) for token, i in vocabulary.items() if i < len(vocabulary) and all(c in back for c in token)}


def piece_bytes(model) -> dict[int, bytes]:
    """Bytes of each id of a sentencepiece model: its piece with spaces, or its one byte."""
    out = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out[i] = bytes([int(piece[3:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i)):
            out[i] = piece.replace(SPACE_PIECE, " ").encode()
    return out


class Aligner:
    """Groups and links of texts. Ids of chunks are remembered up to a bound; their
    alignment is arithmetic on the byte offsets of all tokens of a block.

    A chunk is known by its text, without the space that it begins with if that is its
    only white space there.
    """

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        known = byte_level_bytes(path_a), piece_bytes(self.b)
        #: Numbers of ids of both, their bytes, and the numbers of these.
        self.widths = tuple(max(x) + 1 for x in known)
        self.bytes = [[x.get(i, b"") for i in range(n)] for x, n in zip(known, self.widths, strict=True)]
        self.sizes = [np.array(list(map(len, x))) for x in self.bytes]
        #: Each id of A and then of B as text: inside a group, and at the end of its part of it.
        self.names = [f"{i}{end}" for ends, n in zip((",|", ",;"), self.widths, strict=True) for i in range(n) for end in ends]
        #: Ids of this vocabulary are in the order of its merges.
        self.encode = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in known[0].items()}, special_tokens={}).encode_ordinary
        self.blank = self.b.piece_to_id(SPACE_PIECE)
        #: Chunk -> ids of A and of B, 16 bits each; chunks whose bytes the ids do not give back.
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.bad: set[str] = set()
        if max(self.widths) > 1 << 16:
            raise ValueError("ids are packed into 16 bits")
        if any(re.search(rf"[^{SPACE_PIECE}]{SPACE_PIECE}", self.b.id_to_piece(i)) for i in range(self.b.vocab_size())):
            raise ValueError("a piece goes on over a space, so texts cannot be cut at spaces")

    def learn(self, keys: list[str]) -> None:
        """Remember the ids of chunks."""
        chunks = [k if k[0] in " \n" else " " + k for k in keys]
        # The model puts a space before what it encodes, and gives nothing for nothing.
        ids_b = self.b.encode([x[1:] if x[0] == " " else x for x in chunks], num_threads=1)
        for key, x, b in zip(keys, chunks, ids_b, strict=True):
            a = self.encode(x)
            b = [self.blank] if x == " " else b if x[0] == " " else b[1:]
            if not b"".join(map(self.bytes[0].__getitem__, a)) == b"".join(map(self.bytes[1].__getitem__, b)) == x.encode():
                self.bad.add(key)
            self.memo[0][key], self.memo[1][key] = array("H", a).tobytes(), array("H", b).tobytes()

    def parts(self, parts: list[str]) -> list[tuple[int, int, bytes, str] | None]:
        """Of each part (numbers of ids of A and of B, linked pairs as b << 16 | a in order, groups as text);
        nothing if its bytes are not given back. Parts begin with a space or a line feed."""
        if len(self.memo[0]) > MEMO_ENTRIES:
            for x in (*self.memo, self.bad):
                x.clear()
        keys = list(map(_chunks, parts))
        new = list(set().union(*keys) - self.memo[0].keys())
        self.learn(new)
        good = [not self.bad or self.bad.isdisjoint(k) for k in keys]
        flat = list(chain.from_iterable(compress(keys, good)))
        ids = [np.frombuffer(b"".join(map(memo.__getitem__, flat)), np.uint16).astype(np.int64) for memo in self.memo]
        for k in new:
            if len(k) > MEMO_CHARS:
                del self.memo[0][k], self.memo[1][k]
        upto = np.cumsum([len(p.encode()) for p in compress(parts, good)], dtype=np.int64)
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)]
        ending = []
        for e in ends:
            ending.append(np.zeros(int(upto[-1]) + 1 if len(upto) else 1, bool))
            ending[-1][e] = True
        last = [ending[1][ends[0]], ending[0][ends[1]]]
        # A group's ids of A stand after all ids of the groups before it, and its ids of B after those.
        group = [np.cumsum(x) - x for x in last]
        ended = [np.flatnonzero(x) for x in last]
        place = np.arange(len(ids[0])) + np.concatenate(([0], ended[1] + 1))[group[0]], np.arange(len(ids[1])) + (ended[0] + 1)[group[1]]
        name = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):
            name[place[k]] = 2 * (ids[k] + k * self.widths[0]) + last[k]
        names = list(map(self.names.__getitem__, name.tolist()))
        links = (ids[1][ended[1]] << 16 | ids[0][ended[0]]).astype(np.uint32)
        tokens = [np.searchsorted(e, upto, "right") for e in ends]
        cuts = np.searchsorted(ends[0][ended[0]], upto, "right").tolist()
        sizes = [np.diff(t, prepend=0).tolist() for t in tokens]
        found, begin, cut = [], 0, 0
        for n_a, n_b, end, link in zip(*sizes, (tokens[0] + tokens[1]).tolist(), cuts, strict=True):
            found.append((n_a, n_b, links[cut:link].tobytes(), "".join(names[begin:end])[:-1]))
            begin, cut = end, link
        return [found.pop(0) if g else None for g in good] if not all(good) else found

    def texts(self, texts: list[str | None]) -> list[tuple[list[int], bytes, str]]:
        """Of each text the numbers of A's and B's ids and of groups, its linked pairs in order, and the digest of its groups."""
        some = [i for i, t in enumerate(texts) if t and len(t) <= BLOCK_CHARS]
        done = {i: [x] for i, x in zip(some, self.parts([" " + texts[i] for i in some]), strict=True)}
        return [self._whole(done[i] if i in done else (self.parts([x])[0] for x in _slices(" " + t)) if t else [None]) for i, t in enumerate(texts)]

    def _whole(self, parts: Iterable[tuple[int, int, bytes, str] | None]) -> tuple[list[int], bytes, str]:
        """A text of its parts; a very long one has several."""
        n, links, digest, before = [0, 0, 0], [], hashlib.sha256(), ""
        for part in parts:
            if part is None:
                return [0, 0, 0], b"", ""
            n = [n[0] + part[0], n[1] + part[1], n[2] + len(part[2]) // 4]
            links.append(part[2])
            digest.update((before + part[3]).encode())
            before = ";"
        return n, b"".join(links), digest.hexdigest()


def _chunks(text: str) -> list[str]:
    """The chunks of a text that begins with a space or a line feed."""
    if any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or text[-1] in " \n" or OTHER_SPACE.search(text):
        return CHUNKS.findall(text)
    return text.replace("\n", " \n").split(" ")[1:]


def _slices(text: str) -> Iterator[str]:
    """The text cut into parts of about ``BLOCK_CHARS``, where chunks begin."""
    begin = 0
    while cut := CUT.search(text, begin + BLOCK_CHARS):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """Kept by a Python worker from task to task."""
    return Aligner(path_a, path_b)


def _type(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: A row of a block has the documents' columns if stripe is null, else a stripe's links:
#: places of documents in the block, pairs, and how often the document has each.
BLOCKS = "block long, stripe int, doc_id array<long>, n array<long>, digest array<string>, place binary, pair binary, times binary"
COUNTS = "stripe int, pair binary, count binary"
SCORES = "block long, place binary, n_best binary, count_sum binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that make up blocks."""
    sizes = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
    begin = chars = 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin == BLOCK or chars + size > BLOCK_CHARS):
            yield batch.slice(begin, i - begin)
            begin, chars = i, 0
        chars += size
    if begin < len(sizes):
        yield batch.slice(begin)


def tokenized(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """Blocks of documents with their links by stripe; one pass over the texts."""

    def make():
        work, number = aligner(path_a, path_b), iter(range(1 << 40))
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40

        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in _blocks(batch):
                done = work.texts(part.column("text").to_pylist())
                block = first + next(number)
                lengths = [len(links) // 4 for _, links, _ in done]
                pairs = np.frombuffer(b"".join(links for _, links, _ in done), np.uint32).astype(np.uint64)
                keys, times = np.unique(np.repeat(np.arange(len(done), dtype=np.uint64), lengths) << np.uint64(32) | pairs, return_counts=True)
                place, pair = (keys >> np.uint64(32)).astype(np.uint16), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                stripe = (pair >> np.uint32(16)) % np.uint32(stripes)
                order = np.argsort(stripe, kind="stable")
                found, at = np.unique(stripe[order], return_index=True)
                cut = [order[x:y] for x, y in zip(at, [*at[1:], len(order)][: len(at)], strict=True)]
                none = [None] * len(found)
                yield {
                    "block": [block] * (1 + len(found)),
                    "stripe": [None, *found.tolist()],
                    "doc_id": pa.array([part.column("doc_id").to_pylist(), *none], pa.list_(pa.int64())),
                    "n": pa.array([[x for n, _, _ in done for x in n], *none], pa.list_(pa.int64())),
                    "digest": pa.array([[d for _, _, d in done], *none], pa.list_(pa.string())),
                    "place": [None, *(place[c].tobytes() for c in cut)],
                    "pair": [None, *(pair[c].tobytes() for c in cut)],
                    "times": [None, *(times[c].astype(np.uint32).tobytes() for c in cut)],
                }

        return run

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, _type(BLOCKS))


class Stripe:
    """Counts of one stripe's pairs as a dense matrix: a row for each id of B, a column for each id of A."""

    def __init__(self, stripe: int, widths: tuple[int, int], stripes: int):
        self.stripe, self.stripes = stripe, stripes
        self.counts, self.found = np.zeros((-(-widths[1] // stripes), widths[0]), np.int64), np.zeros(0, np.uint32)

    def places(self, pair: bytes) -> tuple[np.ndarray, np.ndarray]:
        p = np.frombuffer(pair, np.uint32)
        return (p >> np.uint32(16)) // np.uint32(self.stripes), p & np.uint32(0xFFFF)

    def add(self, pair: bytes, count: np.ndarray) -> None:
        np.add.at(self.counts, self.places(pair), count)
        self.found = np.union1d(self.found, np.frombuffer(pair, np.uint32))

    def packed(self) -> tuple[bytes, bytes]:
        """Pairs that occur, and their counts."""
        pair = self.found.tobytes()
        return pair, self.counts[self.places(pair)].tobytes()


def _summed(rows: DataFrame, keys: tuple[str, ...], column: str, kind: type, widths: tuple[int, int], stripes: int) -> DataFrame:
    """Counts of pairs by ``keys``, which begin with the stripe, of blocks of ``column``; blocks are read one after the other."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Stripe(key[0].as_py(), widths, stripes)
        for batch in batches:
            for pair, count in zip(batch.column("pair"), batch.column(column), strict=True):
                matrix.add(pair.as_py(), np.frombuffer(count.as_py(), kind))
        pair, count = matrix.packed()
        yield pa.RecordBatch.from_arrays([pa.array([matrix.stripe], pa.int32()), pa.array([pair], pa.binary()), pa.array([count], pa.binary())], ["stripe", "pair", "count"])

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.select(*keys, "pair", column).groupBy(*keys).applyInArrow(run, COUNTS)


def _scored(links: DataFrame, counts: DataFrame, widths: tuple[int, int], stripes: int) -> DataFrame:
    """Each part's links beside its stripe's counts: by block and document the links to a best id and the sum of counts."""

    def run(key: tuple, blocks: pa.Table, known: pa.Table) -> pa.Table:
        matrix = Stripe(key[0].as_py(), widths, stripes)
        for pair, count in zip(known.column("pair"), known.column("count"), strict=True):
            matrix.add(pair.as_py(), np.frombuffer(count.as_py(), np.int64))
        best = matrix.counts.max(1)
        out = {"block": [], "place": [], "n_best": [], "count_sum": []}
        for block, place, pair, times in zip(*(blocks.column(c) for c in ("block", "place", "pair", "times")), strict=True):
            row, column = matrix.places(pair.as_py())
            count, n = matrix.counts[row, column], np.frombuffer(times.as_py(), np.uint32).astype(np.int64)
            docs, own = np.unique(np.frombuffer(place.as_py(), np.uint16), return_inverse=True)
            sums = np.zeros((2, len(docs)), np.int64)
            np.add.at(sums[0], own, np.where(count == best[row], n, 0))
            np.add.at(sums[1], own, count * n)
            for name, value in zip(out, (block.as_py(), docs.tobytes(), sums[0].tobytes(), sums[1].tobytes()), strict=True):
                out[name].append(value)
        return pa.table(out, pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("place", "n_best", "count_sum"))]))

    keys = ("stripe", "salt")
    return links.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInArrow(run, SCORES)


def _joined(blocks: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents of each block with the sums of their scores over all stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["doc_id"] is not None:
                    docs = row
                else:
                    parts.append((row["place"], row["n_best"], row["count_sum"]))
        sums = np.zeros((2, len(docs["doc_id"])), np.int64)
        for place, best, count in parts:
            at = np.frombuffer(place, np.uint16)
            sums[0, at] += np.frombuffer(best, np.int64)
            sums[1, at] += np.frombuffer(count, np.int64)
        n = np.array(docs["n"], np.int64).reshape(-1, 3)
        columns = [docs["doc_id"], n[:, 0], n[:, 1], n[:, 2], n[:, 2], sums[0], sums[1], docs["digest"]]
        names = [column.split()[0] for column in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "groups_sha256" else pa.int64()) for name, c in zip(names, columns, strict=True)], names)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    left = blocks.where("stripe is null").select("block", "doc_id", "n", "digest")
    return left.unionByName(scores, allowMissingColumns=True).groupBy("block").applyInArrow(run, RESULT)


def pair_counts(blocks: DataFrame, salts: int, widths: tuple[int, int], stripes: int = STRIPES) -> DataFrame:
    """How often the pairs of each stripe are linked in the corpus: parts of a stripe first, then their sum."""
    links = blocks.where("stripe is not null").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    parts = _summed(links, ("stripe", "salt"), "times", np.uint32, widths, stripes)
    return _summed(parts, ("stripe",), "count", np.int64, widths, stripes)


def links_of(blocks: DataFrame) -> int:
    total = blocks.where("stripe is null").select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")).first().n
    return total or 0


def align(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES, share: int = SHARE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    widths = aligner(path_a, path_b).widths
    blocks = written(tokenized(docs, path_a, path_b, stripes), "aligned-blocks")
    salts = max(1, -(-links_of(blocks) // (stripes * share)))
    counts = written(pair_counts(blocks, salts, widths, stripes), "pair-counts")
    links = blocks.where("stripe is not null").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    every = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    scores = written(_scored(links, every, widths, stripes), "link-scores")
    dropped(counts)
    return _joined(blocks, scores)


def best_matches(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """(b_id, a_id, count): for each linked id of B all ids of A with the greatest count, the alignment itself."""
    widths = aligner(path_a, path_b).widths
    blocks = written(tokenized(docs, path_a, path_b, stripes), "aligned-blocks")
    counts = pair_counts(blocks, max(1, -(-links_of(blocks) // (stripes * SHARE))), widths, stripes)

    def make():
        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            for stripe, pair, count in zip(*(batch.column(c) for c in ("stripe", "pair", "count")), strict=True):
                matrix = Stripe(stripe.as_py(), widths, stripes)
                matrix.add(pair.as_py(), np.frombuffer(count.as_py(), np.int64))
                best = matrix.counts.max(1, keepdims=True)
                row, column = np.nonzero((matrix.counts == best) & (best > 0))
                yield {"b_id": row * stripes + matrix.stripe, "a_id": column, "count": matrix.counts[row, column]}

        return run

    return arrow_map(counts, make, _type("b_id long, a_id long, count long"))
