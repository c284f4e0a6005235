"""Operator 12 against a plain alignment of whole texts."""

import collections
import hashlib
import random

import pytest
import public_tokenizers as public

from granary.llm import alignment
from granary.llm.queries import QUERIES
from tests.duck import TESTDATA

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (numbers of ids, groups, links), or nothing, from whole texts and sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    bytes_a, bytes_b = alignment.byte_level_bytes(A), alignment.piece_bytes(b)

    def of(text):
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ((), ())
        parts = [[known.get(i, b"?") for i in x] for known, x in zip((bytes_a, bytes_b), ids, strict=True)]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        ends = [{len(b"".join(p[: i + 1])) if len(p) < 50 else None: i for i in range(len(p))} if len(p) < 50 else _ends(p) for p in parts]
        groups, links, begin = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            upto = ends[0][end] + 1, ends[1][end] + 1
            groups.append("|".join(",".join(map(str, x[i:j])) for x, i, j in zip(ids, begin, upto, strict=True)))
            links.append((ids[1][upto[1] - 1], ids[0][upto[0] - 1]))
            begin = upto
        return len(ids[0]), len(ids[1]), groups, links

    def _ends(parts):
        out, at = {}, 0
        for i, p in enumerate(parts):
            at += len(p)
            out[at] = i
        return out

    return of


def wanted(texts, plain):
    found = [plain(t) for t in texts]
    counts = collections.Counter(x for f in found if f for x in f[3])
    best = {}
    for (b, _), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == best[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) if f else (0, 0, 0, 0, 0, 0, "") for f in found], counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_made_texts(plain):
    """Spaces of all kinds, special tokens, scripts, control characters; also cut into slices."""
    random.seed(5)
    alphabet = [*"ab é\n\t  \x1c\x85\xa0　中文字!?'s1 2ﬁ▁<> \r\x00́😀", "<s>", "<|endoftext|>", "'ll", " the", "\n\n"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(3000)] + ["word " * 500, " ", "\n", "x" * 5000, "中" * 3000]
    work = alignment.Aligner(A, B)
    got = work.texts(texts)
    for text, (n, links, digest) in zip(texts, got, strict=True):
        want = plain(text)
        assert (tuple(n), digest) == ((want[0], want[1], len(want[2])), hashlib.sha256(";".join(want[2]).encode()).hexdigest()) if want else (sum(n), links, digest) == (0, b"", "")
    whole, alignment.BLOCK_CHARS = alignment.BLOCK_CHARS, 20
    try:
        assert work.texts(texts[:300] + texts[-5:]) == got[:300] + got[-5:]
    finally:
        alignment.BLOCK_CHARS = whole


def test_whole_table(spark, plain):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()
    want, _ = wanted([d.text for d in docs], plain)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_tokenizer_alignment"](spark, TESTDATA).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, want, strict=True)}


def test_edge_rows(spark, plain):
    """Null and repeated ids, null, empty and unfit texts, other columns, many salts, an empty table."""
    texts = ["one two two", "one two two", "", None, "a▁b", "tie the tie", "two"]
    rows = [(i, t, "x", 1) for i, t in zip([1, 1, 2, 3, None, 4, None], texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, block int")
    want, counts = wanted(texts, plain)
    got = alignment.align(docs.repartition(4), A, B, stripes=8, share=1).select("doc_id", *COLUMNS).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
    assert alignment.align(docs.limit(0), A, B, stripes=8).collect() == []
    best = {(r.b_id, r.a_id): r["count"] for r in alignment.best_matches(docs, A, B, stripes=8).collect()}
    most = {b: max(n for (x, _), n in counts.items() if x == b) for b, _ in counts}
    assert best == {p: n for p, n in counts.items() if n == most[p[0]]}
