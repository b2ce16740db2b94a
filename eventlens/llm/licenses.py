"""License scan: phrase places, and an exact set-similarity join with license templates.

Texts are cut into blocks (lines and sentences), a block being the set of its words. A
template matches a block that holds at least ``THRESHOLD`` of the template's words.

Notices are wrapped, too. So a template also matches a window of a paragraph, the lines
between blank ones: as many successive words as the template has, divided by
``THRESHOLD``, wherever lines and sentences end. Both sides are then alike, and words
scattered over a paragraph don't match.

The join is exact: words are ordered by their frequency over all blocks, rarest first; of a
template of m words of which o must be found, only the first m-o+1 are indexed, as a
matching block holds one of these (prefix filter); blocks of fewer than o template
words are passed over (length filter); and the first common word must leave enough words
behind it on both sides (positional filter). What remains is compared in full. Paragraphs
pass the same filters as a whole before their windows are compared.

The templates are a bounded list that travels with the plan, so each text is scanned
where it lies: no shuffle. All of it is built-in functions.

Defined cases: a null text is the empty text, with no words, labels '' and score 0; the
first and last word are null without a phrase. Repeated rows are scanned one by one,
extra columns ignored; an empty table yields no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Phrases whose every place counts, and their labels. Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Labels and characteristic sentences of licenses and notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)
#: Templates that may be given; they become expressions.
MOST_TEMPLATES = 500

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BLOCKS = r"[\r\n]+|(?<=[.!?;])[ \t]+"
_PARAGRAPHS = r"(?>\r\n|\r|\n)(?:[ \t\f\x0B]*(?>\r\n|\r|\n))+"


def _whole(words: list[str]) -> str:
    """A pattern of any of the words or phrases, in either case, standing alone."""
    spelled = [(_GAP + "+").join(w.split()) for w in words]
    return rf"(?i)(?<!{_WORD})(?:{'|'.join(spelled)})(?!{_WORD})"


def word_count(text: Column) -> Column:
    """Number of words: runs of digits, ASCII letters and whatever is beyond ASCII."""
    return F.regexp_count(text, F.lit(_WORD + "+")).cast("long")


def block_words(block: Column, vocabulary: list[str]) -> Column:
    """The distinct words of a block that are in the vocabulary, in its order."""
    found = F.regexp_extract_all(block, F.lit(_whole(vocabulary)), F.lit(0))
    return F.array_intersect(F.array(*map(F.lit, vocabulary)), F.transform(found, F.lower))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many blocks of all texts each word of the vocabulary stands. One number a word."""
    blocks = F.explode(F.split("text", _BLOCKS))
    words = docs.select(blocks.alias("block")).select(F.explode(block_words(F.col("block"), vocabulary)).alias("word"))
    return dict(words.groupBy("word").count().collect())


def _postings(templates, order: dict[str, int], threshold: float) -> tuple[Column, list[str], int]:
    """Index of the templates' prefixes: word to templates; the indexed words; the fewest words to find."""
    by_word: dict[str, list[Column]] = {}
    least = []
    for label, text in templates:
        words = sorted(set(text.split()), key=order.__getitem__)
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        least.append(need)
        window = math.floor(len(text.split()) / threshold + 1e-9)
        entry = F.struct(
            F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(len(words)).alias("m"),
            F.lit(need).alias("need"), F.lit(window).alias("window"),
        )
        for word in words[: len(words) - need + 1]:
            by_word.setdefault(word, []).append(entry)
    pairs = [x for word, entries in by_word.items() for x in (F.lit(word), F.array(*entries))]
    return F.create_map(*pairs), list(by_word), min(least)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: words, phrase places, labels and the best containment."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    seen = frequencies(rows, vocabulary)
    vocabulary.sort(key=lambda w: (seen.get(w, 0), w))
    order = {w: k for k, w in enumerate(vocabulary)}
    postings, indexed, least = _postings(templates, order, threshold)

    phrase = _whole([p for p, _ in PHRASES])
    text = F.col("text")
    n_base = F.regexp_count(text, F.lit(phrase)).cast("long")
    # Text before a place, not its index: indices of expressions and of substrings count differently beyond 16 bits.
    before_first = F.element_at(F.split(text, phrase, 2), 1)
    before_last = F.regexp_extract(text, "(?s)^(.*)" + phrase.replace("(?i)", "(?i:") + ")", 1)
    base = F.array_compact(F.array(*[F.when(text.rlike(_whole([p])), F.lit(label)) for p, label in PHRASES]))

    def fitting(words: Column) -> Column:
        """Templates of which a set of words holds enough."""
        candidates = F.array_distinct(F.flatten(F.transform(F.array_intersect(words, F.array(*map(F.lit, indexed))), lambda w: F.element_at(postings, w))))

        def fits(t: Column) -> Column:
            common = F.array_intersect(t["words"], words)
            first = F.element_at(common, 1)
            room = F.least(t["m"] - F.array_position(t["words"], first), F.size(words) - F.array_position(words, first)) + 1
            return (F.size(words) >= t["need"]) & (room >= t["need"]) & (F.size(common) >= t["need"])

        return F.filter(candidates, fits)

    def match(t: Column, common: Column) -> Column:
        return F.struct(t["label"].alias("label"), (common / t["m"]).alias("share"))

    def hits(words: Column) -> Column:
        """Matches of one block: label and containment."""
        return F.transform(fitting(words), lambda t: match(t, F.size(F.array_intersect(t["words"], words))))

    def window_hits(paragraph: Column) -> Column:
        """Matches of the windows of one paragraph: label and the best containment."""

        def best(t: Column) -> Column:
            words = F.transform(F.regexp_extract_all(paragraph, F.lit(_WORD + "+"), F.lit(0)), F.lower)
            starts = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_contains(t["words"], F.element_at(w, i)))
            common = lambda w, i: F.size(F.array_intersect(t["words"], F.slice(w, i, t["window"])))
            # An array of one, so that the words are taken out once.
            return match(t, F.element_at(F.transform(F.array(words), lambda w: F.array_max(F.transform(starts(w), lambda i: common(w, i)))), 1))

        return F.filter(F.transform(fitting(block_words(paragraph, vocabulary)), best), lambda x: x["share"] >= F.lit(threshold - 1e-9))

    # A block is split into words only if it holds an indexed one.
    near = F.filter(F.split(text, _BLOCKS), lambda b: b.rlike(_whole(indexed)))
    long = F.filter(F.transform(near, lambda b: block_words(b, vocabulary)), lambda w: F.size(w) >= least)
    # Windows within one line of one sentence hold no more than its block.
    wrapped = F.filter(F.split(text, _PARAGRAPHS), lambda p: p.rlike(_BLOCKS) & p.rlike(_whole(indexed)))
    found = F.concat(F.flatten(F.transform(long, hits)), F.flatten(F.transform(wrapped, window_hits)))
    matches = F.when(text.rlike(_whole(indexed)), found).otherwise(F.expr("array()").cast("array<struct<label:string,share:double>>"))
    out = rows.select("doc_id", "text", word_count(text).alias("n_words"), n_base.alias("n_base"), matches.alias("matches"))
    out = out.withColumn("base", F.when(F.col("n_base") > 0, base).otherwise(F.expr("array()").cast("array<string>")))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base",
        F.when(F.col("n_base") > 0, word_count(before_first)).alias("first_word"),
        F.when(F.col("n_base") > 0, word_count(before_last)).alias("last_word"),
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
    )
