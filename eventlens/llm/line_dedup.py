"""Line deduplication by winnowing: repeated runs of lines are found by fingerprints, later ones deleted.

A document is the sequence of its lines that have words, each known by the hash of its
trimmed text. Its windows are the shortest stretches of lines that have ``MIN_WORDS``
words, one from every line on and one up to every line. Of each window the smallest line
hash is selected as a fingerprint. What a window is and what it selects depends on its own
lines alone, so two documents that share a run of that many words share fingerprints: this
is the guarantee of winnowing. Neighbouring windows mostly select the same line, so there
are far fewer fingerprints than windows.

Places of equal fingerprints are joined. Around a fingerprint that has several places a
match is extended both ways, to the ends of every window that selected it, as far as the
whole window is found elsewhere too. Of the places of one window the first, in document
order, stays; the others are chained into runs, where they overlap or adjoin, and
deleted. A line of a repeated run lies in the window from the run's first line, or is the
last line of a window within the run. So runs are deleted to both of their ends, however
short or long their lines are, whichever documents hold their parts first.

All is DataFrame expressions. Repeated fingerprints and first places are found by
aggregates that are added up before their shuffle, and the joins with places have one row
a fingerprint or window on that side, so a passage of a third of all documents splits into
as many tasks as it needs. These sides grow with the documents, so none is broadcast,
whatever the size.

Defined cases: null and empty texts stay as they are; documents are ordered by id, nulls
first, then by text hash; rows of one id and one text are one document and get the same
text; a document that loses every line has an empty text. Documents that lose nothing
keep their text to the byte, others lose lines without words too. Extra columns are
kept, but for one named ``n_deleted``, which ``dedup_lines`` replaces; an empty table
yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm._shared import WORD_PATTERN, Scratch

#: Words of a repeated run that is deleted, at least; every such run is found.
MIN_WORDS = SURE_WORDS = 25


def _key() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))


def _lines(text: str) -> Column:
    return F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD_PATTERN))


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, print, at, windows`` of ``key, text``: each selected line, and the windows that selected it.

    A window has ``lo, hi, whole``: its first and last line and the hash of all its lines.
    """
    lines = docs.select("key", _lines("text").alias("lines")).where(F.size("lines") > 0)
    words = lambda x: F.regexp_count(x, F.lit(WORD_PATTERN))
    hashes = F.transform("lines", lambda x: F.xxhash64(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))
    lines = lines.select("key", hashes.alias("h"), F.transform("lines", words).alias("w"))
    # Hashes of lines are dealt by document, not their texts; running sums come from rows,
    # as folding arrays would copy them at each step. Rows of one id and one text are one document.
    at = F.posexplode(F.arrays_zip("h", "w")).alias("pos", "line")
    rows = lines.select("key", at).select("key", "pos", "line.h", "line.w")
    rows = rows.repartition("key").dropDuplicates(["key", "pos"])
    inside = Window.partitionBy("key").orderBy("pos")
    rows = rows.withColumn("end", F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumn("begin", F.col("end") - F.col("w"))
    # Every line has a word, so ``begin`` and ``end`` order lines as ``pos`` does, and frames can be measured in words.
    down = Window.partitionBy("key").orderBy("begin").rangeBetween(0, min_words - 1)
    up = Window.partitionBy("key").orderBy("end").rangeBetween(1 - min_words, 0)
    # The lines of a frame as one array: its hash and its smallest element are taken from the same list.
    rows = rows.withColumn("below", F.collect_list("h").over(down)).withColumn("above", F.collect_list("h").over(up))
    rows = rows.select(
        "key",
        F.when(F.max("end").over(down) - F.col("begin") >= min_words, F.struct(F.col("pos").alias("lo"), F.col("below").alias("all"))).alias("below"),
        # With fewer words before its last line, this is also the window down from its first line.
        F.when(
            F.col("begin") - F.min("begin").over(up) >= min_words, F.struct((F.col("pos") - F.size("above") + 1).alias("lo"), F.col("above").alias("all"))
        ).alias("above"),
    )
    found = rows.select("key", F.explode(F.array_compact(F.array("below", "above"))).alias("x"))
    least = F.array_min("x.all")
    found = found.select(
        "key", least.alias("print"), (F.col("x.lo") + F.array_position("x.all", least) - 1).cast("int").alias("at"),
        F.struct("x.lo", (F.col("x.lo") + F.size("x.all") - 1).alias("hi"), F.xxhash64("x.all").alias("whole")).alias("window"),
    )
    # Rows of one document are together already.
    return found.groupBy("key", "print", "at").agg(F.collect_list("window").alias("windows"))


def repeats(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, lo, hi``: the places of windows but for their first ones."""
    again = scratch.cut(found.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    near = scratch.cut(found.join(again.hint("merge"), "print").select("key", F.explode("windows").alias("x")).select("key", "x.*"))
    first = F.min(F.struct("key", "lo")).alias("first")
    firsts = scratch.cut(near.groupBy("whole").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"))
    later = (F.col("key") != F.col("first.key")) | (F.col("lo") != F.col("first.lo"))
    return near.join(firsts.hint("merge"), "whole").where(later).select("key", "lo", "hi")


def runs(found: DataFrame) -> DataFrame:
    """``key, lo, hi`` of the runs to delete: places that overlap or adjoin are one."""
    line = Window.partitionBy("key").orderBy("lo", "hi")
    reached = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") > reached + 1, 1).otherwise(0)
    marked = found.withColumn("new", new).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("key", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("key", "lo", "hi")


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """``row, text, n_deleted``: each row as a struct, so that its columns can't clash with those of the operator."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"), "text")
    found = runs(repeats(scratch.cut(fingerprints(keyed, min_words)), scratch))
    # A run of one document is deleted by intervals, as many as its lines at most.
    gone = scratch.cut(found.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")).withColumnRenamed("key", "of"))
    joined = keyed.join(gone.hint("merge"), F.col("key").eqNullSafe(F.col("of")), "left")
    kept = F.filter(_lines("text"), lambda x, i: ~F.exists("gone", lambda g: i.between(g["lo"], g["hi"])))
    joined = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    deleted = F.when(F.col("gone").isNull(), 0).otherwise(F.size(_lines("text")) - F.size("kept"))
    return joined.select("row", text.alias("text"), deleted.alias("n_deleted"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "n_deleted"]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted, and ``n_deleted``, the lines that went."""
    return _deduped(docs, min_words).select(*_columns(docs), "n_deleted")


def keep_text(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, with their columns, without later repeated runs and without documents that lost all."""
    left = _deduped(docs, min_words).where(~((F.col("n_deleted") > 0) & (F.col("text") == "")))
    return left.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
