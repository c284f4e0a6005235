"""The corpus pipeline, stage by stage, against brute force on a small fixture."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import personal_data, quality
from tests.llm.test_native import brute_dedup
from tests.llm.test_near_dups import brute as brute_near
from tests.llm.test_quality import brute as brute_counts


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(8)
    syllables = ["ta", "ro", "mi", "len", "ka", "shu", "dor", "vi", "pel", "no", "gar", "ist"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = line(60)
    texts = ["\n".join(line(rng.randint(10, 40)) for _ in range(rng.randint(2, 7))) for _ in range(40)]
    texts += [texts[3] + "\n" + passage, passage + "\n" + texts[7], texts[5], texts[6].replace(" ", "  ", 1)]
    texts += [" ".join(w if i % 90 else word() for i, w in enumerate(texts[k].replace("\n", " ").split())) for k in (1, 2)]
    texts += [texts[9] + "\nwrite to jo.81@mail7.example.com or +1 (017) 555-7713.\nAgain 017-555-7713, or 2024-01-02.", "too short", "again " * 400, "", None]
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out, at = [], str(tmp_path_factory.mktemp("stages"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, at).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "personal_data", "packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[:5])


def test_quality(stages):
    before, after = rows(stages[0]), rows(stages[1])
    bands = quality.Bands()
    for i, r in before.items():
        n, _, _, _, repeated = brute_counts(r.text or "")
        good = n >= 20 and 100 * repeated <= 30 * n and bands((r.text or "").encode())[3]
        assert (i in after) == good
        assert not good or after[i] == r


def test_line_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    texts = [(i, before[i].text) for i in sorted(before)]
    want, deleted = brute_dedup(texts, 50)
    assert {i: after[i].text for i in after} == {i: w for (i, _), w in zip(texts, want, strict=True)}
    assert all(r.n_chars == len(r.text) for r in after.values()) and sum(deleted) > 0


def test_near_dedup(stages):
    before, after = rows(stages[2]), rows(stages[3])
    _, want = brute_near({i: r.text for i, r in before.items()}, 5)
    assert set(after) == {i for i in before if want[i] == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    assert any("<EMAIL> or <PHONE>.\nAgain <PHONE>, or 2024-01-02." in r.text for r in after.values())
    counts: Counter = Counter()
    for r in before.values():
        counts.update(personal_data.counted(r.text))
    crf = personal_data.Field([(*k, n) for k, n in counts.items()])
    for i, r in before.items():
        base = personal_data.base_spans(r.text)
        assert after[i].text == personal_data.masked(r.text, base + crf.added(r.text, base)) and after[i].n_chars == len(after[i].text)


def test_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, parts = rows(stages[4]), defaultdict(list)
    for r in stages[5].collect():
        parts[r.doc_id].append(r)
    assert set(parts) == set(docs)
    for i, r in docs.items():
        assert sum(p.length for p in parts[i]) == len(library.encode(r.text, add_special_tokens=False).ids) + 1


def test_run_equals_the_stages(spark, stages, tmp_path):
    stages[0].write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(stages[5])


def test_edge_rows_and_columns(spark, stages, tmp_path):
    """Null and repeated doc_ids, null and empty texts, columns named as the operators' own, and an empty table."""
    good = stages[4].where("length(text) > 500").select("doc_id", "text").orderBy("doc_id").limit(4).collect()
    rows = [(r.doc_id, r.text, 1, "a", 2, True) for r in good] + [(None, good[0].text + " more", 1, "b", 2, True), (good[1].doc_id, good[2].text + " other", 1, "c", 2, True), (good[3].doc_id, good[3].text, 1, "d", 2, False), (9, None, 1, "e", 2, True), (10, "", 1, "f", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, id string, content int, kept boolean")
    for k, table in enumerate((docs, docs.limit(0))):
        left = table
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, left, str(tmp_path))
            if n < 4:
                assert after.columns == docs.columns
                after.write.parquet(f"{tmp_path}/{k}-{n}")
                left = spark.read.parquet(f"{tmp_path}/{k}-{n}")
                kept = {(r.doc_id, r.id): r.text for r in left.collect()}
        # Rows that repeat doc_id and text stay together. A row that repeats only the doc_id is a document of its
        # own: its lines stand before those of the later document, which keeps its last line only. A row without
        # a doc_id comes after all others and links nothing.
        if not k:
            last = lambda text: text.split("\n")[-1]
            want = {(r.doc_id, "a"): r.text for r in good} | {(good[3].doc_id, "d"): good[3].text, (good[1].doc_id, "c"): good[2].text + " other"}
            assert kept == want | {(good[2].doc_id, "a"): last(good[2].text), (None, "b"): last(good[0].text) + " more"}
        assert (after.count() == 0) == (k == 1)
