"""Operator 4 [native]: line dedup by winnowing over line hashes.

Lines with a word are hashed. From each line a window reaches over as many lines as
hold ``min_words`` words; the smallest line hash in it is selected as a fingerprint,
so any repeated run of that many words is guaranteed to share one, and neighbouring
windows mostly select the same line. Positions of fingerprints are joined by their
hash: one that stands at a single position ends there, and so does most of a corpus.

Around the fingerprints that are left, matches are verified on the hashes of all
their lines and extended both ways, line by line: to the right, a window grows over
each next line for as long as it is the shortest run of ``min_words`` words that ends
there; to the left, by the windows that begin at the lines before. A run that stands
at an earlier position (a smaller doc_id, or a lower line of the same document)
anywhere in the corpus is a match. Matches that touch are one maximal run, and its
lines are deleted. So exactly those lines go that lie in some run of ``min_words``
words or more which stands anywhere before; the first occurrence stays whole.

Each line adds at most three rows to verify. Positions and runs are reduced to
counts and first positions by partial aggregation, no pairs within a group are made,
and joins of runs with first positions are followed by a table or another exchange,
so that adaptive execution can split a hot fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import dropped, written

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def line_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each run to verify: document (id, content), lines first..last, hash and
    line of its fingerprint (print, at), and a hash of all its lines."""
    lines = docs.select("id", "content", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    lines = lines.withColumn("words", F.regexp_count("value", F.lit(WORD))).where("words > 0")
    # One shuffle serves the repeated rows of a document and all windows on it.
    lines = lines.select("id", "content", "line", "words", F.xxhash64("value").alias("h")).repartition("id", "content").distinct()
    document = Window.partitionBy("id", "content")
    placed = lines.withColumn("start", F.sum("words").over(document.orderBy("line")) - F.col("words")).withColumn("end", F.col("start") + F.col("words"))

    def run(over, first: Column, last: Column) -> Column:
        # A minimum that stands in a run twice is selected where it stands first.
        return F.struct(first.alias("first"), last.alias("last"), F.min(F.struct("h", "line")).over(over).alias("least"), F.xxhash64(F.collect_list("h").over(over)).alias("lines"))

    ahead = document.orderBy("start").rangeBetween(Window.currentRow, min_words - 1)
    # Starts of lines and their ends have the same order.
    back = document.orderBy("end").rangeBetween(1 - min_words, Window.currentRow)
    pair = document.orderBy("end").rowsBetween(-1, Window.currentRow)
    whole = F.sum("words").over(document) >= F.col("start") + min_words
    runs = placed.select(
        "id", "content",
        F.when(whole, run(ahead, F.col("line"), F.max("line").over(ahead))).alias("window"),
        # Shorter by its last line it would not do, or it is the window of its first line.
        F.when((F.col("end") >= min_words) & (F.col("start") - F.min("start").over(back) >= min_words), run(back, F.min("line").over(back), F.col("line"))).alias("grown"),
        # Two long lines: each is a window of its own, and blank lines between them go too.
        F.when((F.count("*").over(pair) == 2) & (F.min("words").over(pair) >= min_words), run(pair, F.min("line").over(pair), F.col("line"))).alias("pair"),
    )
    runs = runs.select("id", "content", F.explode(F.array("window", "grown", "pair")).alias("r")).where("r is not null")
    return runs.select("id", "content", "r.first", "r.last", F.col("r.least.h").alias("print"), F.col("r.least.line").alias("at"), "r.lines")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, content, first, last: maximal runs of lines that stand anywhere before."""
    runs = written(line_runs(docs, min_words), "runs")
    prints = runs.select("id", "content", "at", "print").distinct()
    # Tables of their own here and below, so that a join does not share an aggregate's partitions and its hot keys can be split.
    shared = written(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "shared-prints")
    some = written(runs.join(shared, "print", "left_semi"), "shared-runs")
    position = F.struct(F.col("id").isNull().alias("unnamed"), "id", "content", F.col("first").alias("line"))
    earliest = written(some.groupBy("print", "lines").agg(F.min(position).alias("earliest"), F.count("*").alias("n")).where("n > 1"), "first-positions")
    again = some.join(earliest, ["print", "lines"]).where(position != F.col("earliest"))
    order = Window.partitionBy("id", "content").orderBy("first")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") <= before + 1, 0).otherwise(1)
    marked = again.select("id", "content", "first", "last", opens.alias("opens"))
    joined = marked.withColumn("run", F.sum("opens").over(order)).groupBy("id", "content", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = written(joined.drop("run"), "repeated-runs")
    for old in (runs, shared, some, earliest):
        dropped(old)
    return found


def _edited(docs: DataFrame, min_words: int) -> tuple[DataFrame, Column]:
    """``docs`` as ``d``, joined with its ``runs`` (struct column ``r.runs``), and the text that is left."""
    named = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("content"), "text").where("text is not null")
    runs = repeated_runs(named, min_words).groupBy("id", "content").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = docs.alias("d").join(runs.alias("r").hint("shuffle_hash"), F.col("d.doc_id").eqNullSafe(F.col("r.id")) & (F.xxhash64("d.text") == F.col("r.content")), "left")
    spared = F.filter(F.split("d.text", "\n"), lambda x, i: ~F.exists("r.runs", lambda r: i.between(r["first"], r["last"])))
    return joined, F.when(F.col("r.runs").isNull(), F.col("d.text")).otherwise(F.array_join(spared, "\n"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``; all other columns as they were.

    Edge cases as in :func:`line_dedup`.
    """
    joined, text = _edited(docs, min_words)
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and three columns
    more: n_lines, n_deleted_lines and n_runs (long).

    Blank lines carry no hash; those inside a deleted run go with it. A null text
    has no lines and stays null, an empty one has one blank line; a document of
    which all lines were seen before keeps its row with an empty text. Rows with
    a null doc_id come after all others. Rows that repeat doc_id and text count as
    one document and lose the same lines; rows that repeat only doc_id are ordered
    by a hash of their text. Existing columns named as the new ones are replaced.
    An empty table gives no rows.
    """
    fresh = ("n_lines", "n_deleted_lines", "n_runs")
    joined, text = _edited(docs, min_words)
    gone = F.aggregate("r.runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in fresh),
        F.coalesce(F.size(F.split("d.text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted_lines"),
        F.coalesce(F.size("r.runs"), F.lit(0)).cast("long").alias("n_runs"),
    )
