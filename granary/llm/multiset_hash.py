"""Operator 6 [native]: document fingerprints by a homomorphic multiset hash.

Every paragraph (line) hashes to a wide vector of integers; a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two. So the order of paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (:func:`added`, :func:`removed`).

The vector has three parts. ``DENSE`` lanes of 32 bits come from hashes of the
paragraph and decide equality. Lanes of 8 bits in ``LEVELS`` levels tell likeness:
each sentence of the paragraph adds a value to one lane of one level, a level
getting half of the sentences that the one before gets. So among any number of
differing sentences some level is neither empty nor full, and the lanes that differ
there, and in the levels after it, tell how many sentences differ. The last part
is the number of sentences.

Lanes of 8 bits stand by sevens in 56 bits of a long, and are added and subtracted
together without carries between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import below

HALVES, DENSE_BITS = 2, 32
DENSE = 8 * HALVES
LEVELS, WORDS, PACKED = 10, 9, 7
LANES = WORDS * PACKED
#: A level with more differing lanes than this is full; the estimate begins after it.
FULL = 48
COUNT_BITS = 32
LOW, HIGH, ALL = 0x7F7F7F7F7F7F7F, 0x80808080808080, 0xFFFFFFFFFFFFFF


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _plus(x: Column, y: Column) -> Column:
    """Lane by lane sum of two longs of seven lanes."""
    return (x.bitwiseAND(LOW) + y.bitwiseAND(LOW)).bitwiseXOR(x.bitwiseXOR(y).bitwiseAND(HIGH))


def _minus(x: Column, y: Column) -> Column:
    return (x.bitwiseOR(HIGH) - y.bitwiseAND(LOW)).bitwiseXOR(x.bitwiseXOR(y).bitwiseXOR(ALL).bitwiseAND(HIGH))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def vector(text: Column) -> Column:
    """Lanes of a text: struct of ``dense`` and ``strata`` (arrays of longs) and ``n``, the number of sentences.

    Paragraphs end at line feeds, sentences also at a full stop and space. A text
    without any is one empty paragraph.
    """
    paragraphs = F.split(text, "\n")
    digests = F.transform(paragraphs, lambda p: F.concat(*(F.sha2(F.concat(F.lit(str(k)), p), 256) for k in range(HALVES))))
    starts = F.array(*(F.lit(1 + 8 * i) for i in range(DENSE)))
    dense = F.aggregate(digests, _zeros(DENSE), lambda acc, d: F.zip_with(acc, starts, lambda v, at: (v + _number(F.substr(d, at, F.lit(8)))) % (1 << DENSE_BITS)))
    sentences = F.split(F.replace(text, F.lit(". "), F.lit("\n")), "\n")

    def place(number: Column) -> Column:
        lane, rest = number % LANES, F.call_function("div", number, F.lit(LANES))
        code = F.call_function("div", rest, F.lit(255)) % (1 << (LEVELS - 1))
        level = F.when(code == 0, LEVELS - 1).otherwise(LEVELS - 1 - F.length(F.bin(code)))
        value = F.call_function("shiftleft", rest % 255 + 1, (8 * (lane % PACKED)).cast("int"))
        return F.struct(level.alias("level"), F.call_function("div", lane, F.lit(PACKED)).cast("int").alias("word"), value.alias("value"))

    placed = F.transform(F.transform(sentences, lambda s: _number(F.substr(F.md5(s), F.lit(1), F.lit(12)))), place)

    def add(acc: Column, x: Column) -> Column:
        level = lambda words: F.transform(words, lambda v, i: F.when(i == x["word"], _plus(v, x["value"])).otherwise(v))
        return F.transform(acc, lambda words, k: F.when(k == x["level"], level(words)).otherwise(words))

    strata = F.flatten(F.aggregate(placed, F.array_repeat(_zeros(WORDS), LEVELS), add))
    return F.struct(dense.alias("dense"), strata.alias("strata"), F.size(sentences).cast("long").alias("n"))


def fingerprint(lanes: Column) -> Column:
    """Lower-case hexadecimal digits of all lanes, in order."""
    part = lambda values, digits: F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), digits, "0"))), "")
    return F.concat(part(lanes["dense"], DENSE_BITS // 4), part(lanes["strata"], 2 * PACKED), part(F.array(lanes["n"]), COUNT_BITS // 4))


def _combined(a: Column, b: Column, sign: int) -> Column:
    dense = F.zip_with(a["dense"], b["dense"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << DENSE_BITS)))
    strata = F.zip_with(a["strata"], b["strata"], _plus if sign > 0 else _minus)
    return F.struct(dense.alias("dense"), strata.alias("strata"), F.pmod(a["n"] + sign * b["n"], F.lit(1 << COUNT_BITS)).alias("n"))


def added(a: Column, b: Column) -> Column:
    """Lanes of the union of two multisets of paragraphs."""
    return _combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """Lanes of ``a`` without the paragraphs of ``b``."""
    return _combined(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common sentences (0 to 1; 1 for equal fingerprints only).

    With D differing sentences in a level, a lane stays equal with probability
    (1 - 1/LANES)^D. The levels after the last full one hold a known share of all
    sentences, so their estimates, scaled up, give D for the document, and with the
    two counts n and m the Jaccard likeness (n + m - D) / (n + m + D), not below 0.
    Some 100 sentences or more are counted where a level is full, so the estimate
    errs by a tenth of D at most in most cases, whatever the length. Six decimals.
    """
    apart = F.zip_with(a["strata"], b["strata"], lambda x, y: x.bitwiseXOR(y))
    lanes = F.transform(apart, lambda z: F.bit_count((z.bitwiseAND(LOW) + LOW).bitwiseOR(z).bitwiseAND(HIGH)))
    total = lambda values, zero: F.aggregate(values, zero, lambda s, x: s + x)
    differ = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: total(F.slice(lanes, k * WORDS + 1, WORDS), F.lit(0)))
    first = F.least(F.array_max(F.transform(differ, lambda d, k: F.when(d > FULL, k + 1).otherwise(0))), F.lit(LEVELS - 1))
    counted = F.transform(differ, lambda d: F.log(1 - F.least(d.cast("double"), F.lit(LANES - 0.5)) / LANES) / math.log(1 - 1 / LANES))
    # One struct, so that no expression is doubled.
    state = F.struct(first.alias("first"), counted.alias("counted"), (a["n"] + b["n"]).cast("double").alias("both"))

    def estimate(s: Column) -> Column:
        d = total(F.slice(s["counted"], s["first"] + 1, F.lit(LEVELS)), F.lit(0.0)) * F.pow(F.lit(2.0), s["first"])
        return F.least(F.lit(0.999999), F.round(F.greatest(F.lit(0.0), (s["both"] - d) / (s["both"] + d)), 6))

    value = F.get(F.transform(F.array(state), estimate), 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).otherwise(value)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row (null text: empty)."""
    return docs.select("doc_id", fingerprint(vector(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("fingerprint"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses.

    The edited text has the last floor(n_chars/2) code points replaced by the first
    as many of the next document in descending doc_id; the first document follows
    the last. Null text counts as empty. Rows with the same doc_id have the same next
    document, and of several rows with the next doc_id the least text is it. A row
    with a null doc_id has no next document: its edited text is its first half and
    ``near_next`` is null. A single document is its own next one. Other columns are
    ignored; an empty table gives no rows.

    Only ids are put in order (:func:`below`). Texts are shuffled by doc_id once; each
    document then sends the head that the one before it needs, and its lanes, so a
    text is never sent whole to another, and no task holds more than its share.
    """
    # Without an alias where none is needed: it would stay on one side of the join only, and make two exchanges of texts.
    key = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    half = lambda text: F.call_function("div", F.length(text), F.lit(2)).cast("int")
    # The same filter on every side of the joins, so that the exchange of texts is one and is reused.
    named = rows.where("doc_id is not null")
    wanted = named.groupBy("doc_id").agg(F.max(half(F.col("text"))).alias("half"))
    last = named.agg(F.max("doc_id")).first()[0]
    after = below(rows.select("doc_id"), "doc_id").select(F.col("doc_id").alias("id"), F.coalesce("below", F.lit(last)).alias("next"))
    needs = wanted.join(after, F.col("doc_id") == F.col("id")).select("id", "next", "half")
    dealt = named.withColumn("lanes", vector(F.col("text"))).repartition("doc_id")
    one = dealt.groupBy("doc_id").agg(F.min(F.struct("text", "lanes")).alias("of"))
    heads = one.join(needs, F.col("doc_id") == F.col("next")).select("id", F.substring("of.text", F.lit(1), F.col("half")).alias("head"), F.col("of.lanes").alias("next_lanes"))
    pairs = dealt.join(heads, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "lanes", "head", "next_lanes")
    none = dict(pairs.dtypes)
    nameless = rows.where("doc_id is null").select("doc_id", "text", vector(F.col("text")).alias("lanes"), *(F.lit(None).cast(none[c]).alias(c) for c in ("head", "next_lanes")))
    pairs = pairs.union(nameless)
    n, own = F.length("text"), half(F.col("text"))
    edited = F.concat(F.substring("text", F.lit(1), n - own), F.coalesce(F.substring("head", F.lit(1), own), F.lit("")))
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), "lanes", "next_lanes", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "lanes", "next_lanes", vector(F.col("edited")).alias("edited_lanes"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("lanes")).alias("fingerprint"), fingerprint(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
