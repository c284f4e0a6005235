"""Operators 3, 5 and 10 against the tokenizers library and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import packing, pieces, token_files, transducer
from tests.duck import TESTDATA

WORD, BYTE, RANKS = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
library = Tokenizer.from_file(WORD)
byte_library = Tokenizer.from_file(BYTE)
TEXTS = [
    None, "", " ", "\n", "a", "Hello,  world!\nIt's 3.14 o'clock; they'll've", "x" * 20000, "=" * 9000 + "'s" + "ab" * 5000, "<|endoftext|> in a text<|startoftext|>",
    "É́ Σοφίας ΣΑΣ İstanbul ½ ² ª º ǅ​　 日本語 🎉🎉", "'tis the 'season 's ' t'd''ve", "tab\there\x1c\x85\xa0z", "foo_bar __init__ a-b", "2024 12,5", "Straße ÜBER", "  lead", "trail  ", "a  b", "a \n b", "end.\n\nNext",
    "thousand " * 3000, "abcdefghij" * 700 + " tail", "mo" * 4000 + "<|endoftext|>" + "!" * 8000,
]
ALPHABET = st.text(alphabet=st.sampled_from(list("abcdemnorstuABT'’.,!_- \n\t012éßÉàΣσ²½́日🎉<|>")), max_size=60)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", t) for i, t in enumerate(texts)], "doc_id long, text string, ids string, rank string")


@pytest.fixture(scope="module")
def encoder():
    return transducer.codec(WORD)[0]


def encoded(encoder, text, step=1 << 16):
    return [i for at in range(0, len(text), step) for i in encoder.feed(text[at : at + step])] + encoder.close()


@settings(max_examples=400, deadline=None)
@given(ALPHABET, st.integers(1, 9))
def test_transducer_equals_the_library(text, step):
    encoder = transducer.codec(WORD)[0]
    assert encoded(encoder, text, step) == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pieces.word_tokenizer(WORD).ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_byte_tokenizer_equals_the_library(text):
    assert np.frombuffer(pieces.byte_tokenizer(BYTE, RANKS).ids(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_given_texts(encoder):
    for text in filter(None, TEXTS):
        want = library.encode(text, add_special_tokens=False).ids
        for step in (1 << 16, 1000, 7):
            assert encoded(encoder, text, step) == want, (text[:40], step)
        assert np.frombuffer(pieces.word_tokenizer(WORD).ids(text), "<u4").tolist() == want
        assert np.frombuffer(pieces.byte_tokenizer(BYTE, RANKS).ids(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids, text[:40]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abdefimnorstu", min_size=1, max_size=700))
def test_lookahead_is_sufficient(word):
    encoder = transducer.codec(WORD)[0]
    m = encoder.m
    encoder.open = []
    ids = encoder._grow(m.symbols(word)) + encoder._end()
    assert ids == library.encode(word, add_special_tokens=False).ids


def test_memory_of_unbroken_runs_is_constant():
    """5 million characters of one unbroken run, in several scripts, against the library's ids of its slices' hash."""
    rng = np.random.default_rng(4)
    encoder = transducer.Encoder(transducer.codec(WORD)[0].m)
    bound = 2 * encoder.m.ahead + 2 * transducer.STEP
    runs = {
        "cjk": "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20_000))) * 250, "letters": "ab" * 100_000, "greek": "\u03b1\u03b2\u03b3\u03a3" * 20_000, "signs": "=" * 100_000 + "'" * 50_000, "tabs": "a\tb\t" * 50_000,
    }
    for name, text in runs.items():
        n = most = 0
        for at in range(0, len(text), 4096):
            n += len(encoder.feed(text[at : at + 4096]))
            most = max(most, encoder.kept())
        assert most < bound, (name, most)
        part = text[:40_000]
        assert n + len(encoder.close()) > 0 and encoded(encoder, part, 4096) == library.encode(part, add_special_tokens=False).ids, name


def test_ids_of_the_documents_come_out_ahead(encoder):
    """In small chunks, a good part of all ids is emitted before its pre-token has ended."""
    docs = pq.read_table(f"{TESTDATA}/documents.parquet", columns=["text"]).column(0).to_pylist()[:60]
    before, n = encoder.ahead_ids, 0
    for text in docs:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert encoded(encoder, text or "", 5) == want
        n += len(want)
    fresh = transducer.Encoder(encoder.m)
    assert [fresh.word("internationalization"), fresh.ahead_ids >= 0]
    assert encoder.ahead_ids - before > n / 1000


def test_marks_are_held_until_they_are_certain(encoder):
    for text in ("e" + "\u0301" * 300 + "x", "\u1112\u1161\u11ab" * 50, "<\u0338|endoftext|>", "a<|endof", "a<|endoftext|>\u0301b", "\u0915\u093c" * 40, "'" * 7 + "s", "1'2'3're4", "it's'"):
        want = library.encode(text, add_special_tokens=False).ids
        for step in (1, 2, 3, 100):
            assert encoded(encoder, text, step) == want, (text, step)


def test_byte_mode_decoder_is_incremental():
    encoder, _, _ = transducer.codec(WORD)
    decoder = transducer.Decoder(encoder.m, as_bytes=True)
    ids = encoded(encoder, "日本語 🎉 hello, world")
    assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == "日本語 🎉 hello , world "


def test_round_trip_rows(spark):
    got = {r.doc_id: r for r in transducer.round_trip(frame(spark, TEXTS), WORD).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert transducer.round_trip(frame(spark, []), WORD).count() == 0
    assert {r.doc_id: r.ids for r in transducer.coded(frame(spark, TEXTS[:6]), WORD).collect()}[5] == library.encode(TEXTS[5], add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1]), max_size=40))
def test_rank_coding_round_trip(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, "<u4"))
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks


def test_token_files(spark):
    docs = frame(spark, TEXTS).repartition(3)
    path = token_files.write_token_files(docs, WORD, block_ids=300)
    got = sorted(token_files.read_token_files(spark, path).collect())
    start = 0
    for row, text in zip(got, TEXTS, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_file_digest(frame(spark, []), WORD).count() == 0
    again = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in sorted(token_files.token_file_digest(again, WORD).collect(), key=lambda r: r.start)] == [(None, 0), (1, 3), (3, 4), (3, 6)]


def check_packing(rows, texts):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc, text in enumerate(texts):
        ids = np.array([*byte_library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence)


def test_packing(spark):
    check_packing(packing.pack(frame(spark, TEXTS), BYTE, RANKS).collect(), TEXTS)
    assert packing.pack(frame(spark, []), BYTE, RANKS).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1))
def test_plan_uses_each_piece_once(histogram):
    used = defaultdict(int)
    for lengths, n in packing.plan(histogram, 64):
        assert sum(lengths) <= 64 and n > 0
        for v in lengths:
            used[v] += n
    assert used == histogram


def test_plan_pads_little():
    rng = np.random.default_rng(5)
    lengths, n = np.unique(np.clip(rng.gamma(2, 200, 200_000).astype(int) + 1, 1, 1023), return_counts=True)
    plan = packing.plan(dict(zip(lengths.tolist(), n.tolist(), strict=True)))
    sequences = sum(k for _, k in plan)
    assert (lengths * n).sum() / (1024 * sequences) > 0.99


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=17, max_size=17))
def test_solution_is_the_non_negative_optimum(counts):
    """Conditions of an optimum: no combination that is used or unused would lower the weighted squares."""
    histogram = np.array([0, *counts[1:]], float)
    rows = packing.combinations(16)
    x = packing.solve(histogram, rows, steps=6000)
    a = np.stack([np.bincount(row, minlength=17) for row in rows], 1).astype(float)
    a[0] = 0
    weight = 1 / np.maximum(a.sum(1), 1)
    pull = a.T @ (weight * (histogram - a @ x))  # how fast the squares fall with each repeat count
    assert (x >= 0).all() and pull.max(initial=0) < 1e-2 and np.abs(pull[x > 1e-2]).max(initial=0) < 1e-2


def test_null_and_repeated_rows(spark):
    """A null doc_id and rows that repeat one are rows like others, in the round trip and in packing."""
    docs = spark.createDataFrame([(None, "a b", 1), (3, "c d e", 2), (3, "c d e", 3), (3, "other", 4), (None, None, 5)], "doc_id long, text string, n_tokens int")
    count = lambda t, tok: len(tok.encode(t, add_special_tokens=False).ids)
    got = sorted((str(r.doc_id), r.n_tokens) for r in transducer.round_trip(docs, WORD).collect())
    assert got == sorted([("None", count("a b", library)), ("3", count("c d e", library)), ("3", count("c d e", library)), ("3", count("other", library)), ("None", 0)])
    rows = packing.pack(docs, BYTE, RANKS).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == sorted([("None", count("a b", byte_library) + 1), ("3", count("c d e", byte_library) + 1), ("3", count("c d e", byte_library) + 1), ("3", count("other", byte_library) + 1), ("None", 1)])
    assert {r.sequence_id for r in rows} == {0} and sorted(r.offset for r in rows) == list(np.cumsum([0] + [r.length for r in sorted(rows, key=lambda r: r.offset)])[:-1])
