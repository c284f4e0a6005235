"""Operator 1: MinHash near-duplicates with Odd sketches.

Each document's set of word shingles gives MinHash samples. Bands of samples make
bucket keys; the samples are also folded into an Odd sketch, a bitmap in which
every (position, sample) flips one bit, so that the population count of two
sketches' XOR estimates how many samples differ, precisely so at high similarity.

Equal sets are collapsed to one representative first, so copies never meet in a
bucket; a representative has an id of its own, as a doc_id may name several texts.
In a bucket, every member is compared with the bucket's smallest id only.
Pairs whose lengths or sketches rule out the threshold are discarded, as are those
whose parity bitmaps of the full sets differ in more bits than elements may: an
element that only one set has flips one bit, so that bound is exact. The others are
confirmed on full sets. Where a bucket still spans several components, further
members become such hubs: first some of the component that most belong to, then
those outside it, more each round, until the others are of one component. So no
link between members of a bucket is lost, while a group that hangs together costs
few comparisons a member. Members of a large bucket are dealt over salts, and each
salt gets the hubs, so one bucket is the work of many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import arrow_map, dropped, written
from granary.llm.components import components, joined
from granary.llm.words import grams, hashed_words, mix, table

BANDS, ROWS = 40, 5
SKETCH_BITS = 1024
#: Standard deviations of the sample below the threshold at which a sketch rules a pair out.
SKETCH_SIGMAS = 5.0
BLOCK = 1024
#: Probes of a bucket's main component in the first round that needs them, and members
#: outside it in the next round; eight times as many in each round after.
PROBES, HUBS = (16,), 256
#: Members of a bucket to a salt.
SALT_ROWS = 2048

SIGNATURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("content", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())),
])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.BinaryType())])


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    _, h = hashed_words((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(grams(h, min(words, len(h)) or 1))


def parity(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` in 64-bit words, in which each value flips one bit."""
    odd = np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


class Signer:
    """MinHash samples of a set, their bands, their Odd sketch, and the parity bitmap of the whole set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS):
        self.bands, self.rows, self.bits = bands, rows, bits
        self.times = table(bands * rows, 11)[:, None]
        self.plus = table(bands * rows, 12)[:, None]
        self.band = table(bands, 13)
        self.position = table(bands * rows, 14)

    def samples(self, elements: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(elements), BLOCK):
            got = ((elements[at : at + BLOCK] * self.times + self.plus) >> np.uint64(16)).min(1)
            least = got if least is None else np.minimum(least, got)
        return least

    def __call__(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.samples(elements)
        keys = self.band.copy()
        for row in s.reshape(self.bands, self.rows).T:
            keys = mix(keys ^ row)
        return keys.view(np.int64), parity(mix(s ^ self.position), self.bits), parity(elements, self.bits)


def most_differing_bits(threshold: float, samples: int, bits: int, sigmas: float = SKETCH_SIGMAS) -> int:
    """Greatest XOR population count that the sketches of a pair at the threshold show.

    Binomially many samples differ, and each flips two random bits, of which those
    that fall together cancel out. Both spreads are allowed for.
    """
    p = 1 - threshold
    flips, stays = 2 * samples * p, 1 - 2 / bits
    odd = bits / 2 * (1 - stays**flips)
    sampling = 2 * stays**flips * math.sqrt(samples * p * (1 - p))
    folding = math.sqrt(2 * flips * flips / bits)
    return math.ceil(odd + sigmas * math.hypot(sampling, folding))


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    def make():
        signer = Signer(bands, rows, bits)

        def work(batch: pa.RecordBatch):
            ids, contents, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for at in range(0, len(ids), 128):
                out: dict[str, list] = {n: [] for n in SIGNATURE.names}
                for doc, content, text in zip(ids[at : at + 128], contents[at : at + 128], texts[at : at + 128].to_pylist(), strict=True):
                    e = shingles(text, words)
                    key, sketch, whole = signer(e) if len(e) else (None, None, None)
                    a, b = (int(mix(e ^ np.uint64(k)).sum().astype(np.int64)) for k in (3, 5))
                    for n, v in zip(SIGNATURE.names, (doc, content, len(e), a, b, key, sketch, whole), strict=True):
                        out[n].append(v)
                yield out

        return work

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("content"), "text"), make, SIGNATURE)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """Full shingle sets of ``docs`` (id, text)."""

    def make():
        def work(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 128):
                yield {"id": ids[at : at + 128], "shingles": [shingles(t, words).tobytes() for t in texts[at : at + 128].to_pylist()]}

        return work

    return arrow_map(docs, make, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= ``percent`` * union on full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def make():
        def work(batch: pa.RecordBatch):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

        return work

    return arrow_map(joined, make, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    Null, empty and blank texts have no shingles and no links: their component is
    their own doc_id. A row with a null doc_id cannot name a component; it has a
    null component_id, links nothing and is kept. Rows that repeat a doc_id are
    linked by their own texts, each row being a document: two texts of one doc_id can
    have different components. Ties cannot occur, as the smallest id of a component
    names it. Other columns are ignored; an empty table gives no rows. Texts are read
    whole, whatever their length.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return classes(docs, words, percent, bands, rows, bits).drop("content")


def classes(docs: DataFrame, words: int, percent: int, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """As :func:`near_duplicates`, for ``docs`` (doc_id, text), with ``content``, a hash of each row's text."""
    limit = most_differing_bits(percent / 100, bands * rows, bits)
    signed = written(signatures(docs, words, bands, rows, bits), "signatures")
    made = [signed]

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    key = ["n_shingles", "set_a", "set_b"]
    # One representative for each different set, and the smallest doc_id that has it.
    named = signed.where("doc_id is not null and n_shingles > 0")
    reps = named.groupBy(*key).agg(F.min(F.struct("doc_id", "content", "bands", "sketch", "parity")).alias("r"))
    reps = keep(reps.select(F.monotonically_increasing_id().alias("id"), *key, F.col("r.doc_id").alias("doc"), "r.content", "r.bands", "r.sketch", "r.parity"), "representatives")
    info = reps.select("id", "doc", "content", F.col("n_shingles").alias("n"), "sketch", "parity", "bands")

    members = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = keep(members.join(hubs, "bucket").select("id", "bucket", "band", "hub"), "members")
    shared = keep(info.join(members.select("id").distinct(), "id"), "candidates")
    whose = shared.select("id", F.col("doc").alias("doc_id"), "content")
    texts = docs.withColumn("content", F.xxhash64("text")).join(whose, ["doc_id", "content"])
    sets = full_sets(texts.select("id", "text"), words)
    if _repeats(signed):  # rows that repeat doc_id and text
        sets = sets.dropDuplicates(["id"])
    sets = keep(sets, "sets")

    def possible(n: Column, m: Column, samples_apart: Column, sets_apart: Column) -> Column:
        """Whether sizes, sketches and parity bitmaps allow the threshold."""
        sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
        return sizes & (samples_apart <= limit) & ((100 + percent) * sets_apart <= (100 - percent) * (n + m))

    def apart(s: str, t: str) -> Column:
        """Population count of the XOR of two bitmaps."""
        return F.aggregate(F.zip_with(s, t, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: shared.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"), F.col("parity").alias(f"p_{c}"))
        both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        return written(confirmed(both.where(possible(F.col("n_a"), F.col("n_b"), apart("s_a", "s_b"), apart("p_a", "p_b"))), sets, percent), "links")

    links = verified(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    found = components(links)
    made += [links, found]
    found = keep(shared.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
    # The hub has met all others of its bucket. In what is left of a bucket, members
    # outside the component that most belong to become hubs in turn.
    live = _unsettled(members.where("id != hub").select("id", "bucket", "band"), found)
    if not live.isEmpty():
        # Words of bitmaps and band keys as columns: a condition on them is compiled as a whole.
        words_, sets_ = ([f"{c}{i}" for i in range(bits // 64)] for c in "sp")
        keys_ = [f"b{i}" for i in range(bands)]
        flat = shared.select("id", "n", *(F.col("sketch")[i].alias(c) for i, c in enumerate(words_)), *(F.col("parity")[i].alias(c) for i, c in enumerate(sets_)), *(F.col("bands")[i].alias(c) for i, c in enumerate(keys_)))
        live = written(live.join(flat, "id"), "unsettled")
        turn = 0
        while not live.isEmpty():
            probing = turn < len(PROBES)
            hub = written(_hubs(live, probing, PROBES[turn] if probing else HUBS * 8 ** (turn - len(PROBES))), "hubs")
            wide = live.select("bucket", "id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"h_{c}") for c in ("id", "component", "n", *words_, *sets_, *keys_)))
            wide = wide.join(hub, ["bucket", "id"]).drop("id").withColumnRenamed("bucket", "h_bucket").withColumnRenamed("salt", "h_salt")
            flipped = lambda names: reduce(lambda x, y: x + y, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"h_{c}"))) for c in names))
            meet = (F.col("component") != F.col("h_component")) & possible(F.col("n"), F.col("h_n"), flipped(words_), flipped(sets_))
            if not probing:
                # Two members of several common buckets meet in the first of them only.
                meet = reduce(lambda x, y: x & y, ((F.col("band") <= k) | (F.col(c) != F.col(f"h_{c}")) for k, c in enumerate(keys_)), meet)
            at = (F.col("bucket") == F.col("h_bucket")) & (F.col("salt") == F.col("h_salt"))
            met = live.join(wide, at & meet).select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct()
            more = written(confirmed(met, sets, percent), "links")
            if not more.isEmpty():
                found = joined(found, more)
                made.append(found)
            rest = live.drop("component", "salt", "salts")
            if not probing:  # probes stay: they are of the main component and have met its outsiders only
                rest = rest.join(hub, ["bucket", "id"], "left_anti")
            newer = written(_unsettled(rest, found), "unsettled")
            for old in (live, hub, more):
                dropped(old)
            live, turn = newer, turn + 1
        dropped(live)

    # A component is named by the smallest doc_id of its representatives.
    names = found.join(reps.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("name"))
    of = found.join(names, "component").select("id", "name")
    sets_named = reps.select(*key, "id", "doc").join(of, "id", "left").select(*key, F.coalesce("name", "doc").alias("name"))
    out = signed.select("doc_id", "content", *key).join(sets_named, key, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("name")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "content", "n_shingles", component.alias("component_id"))
    out = written(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "classes")
    for old in made:
        dropped(old)
    return out


def _repeats(signed: DataFrame) -> bool:
    """Whether any doc_id names several rows."""
    return not signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that span several components, with their component, salt and the bucket's number of salts."""
    named = members.join(found, "id")
    span = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    salts = F.ceil(F.col("size") / SALT_ROWS).cast("int")
    return named.join(span.select("bucket", salts.alias("salts")), "bucket").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))


def _hubs(live: DataFrame, main_ones: bool, most: int) -> DataFrame:
    """(bucket, id): in each bucket up to ``most`` members, in order of a hash, of the
    component that most belong to, or else of the others. First in each salt, then of those."""
    sizes = live.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    side = live.select("bucket", "salt", "id", "component").join(main, "bucket").where((F.col("component") == F.col("main")) == F.lit(main_ones))
    order = (F.xxhash64("id", "bucket"), "id")
    first = side.select("bucket", "salt", "id").repartition("bucket", "salt").withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(*order))).where(F.col("nth") <= most)
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("nth") <= most).select("bucket", "id")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns as they were.

    Rows are told apart by doc_id and text: rows that repeat both stay or go together,
    rows that repeat only the doc_id are judged by their own texts.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = classes(plain, words, percent, **options).where("kept").select(F.col("doc_id").alias("k"), F.col("content").alias("c")).distinct().alias("kept")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("kept.k")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("kept.c"))
    return docs.alias("d").join(kept, same, "left_semi").select(*(F.col(f"d.`{c}`") for c in docs.columns))
