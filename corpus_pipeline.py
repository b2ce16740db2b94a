"""From raw documents to packed sequences: five stages, each one of the corpus operators.

Each stage takes what its predecessor kept and returns documents with their own columns;
the last one returns pieces of sequences. Stages are written as Parquet and read again,
in the shared folder of the session, so a lost executor costs at most one stage. A stage's
rows are deleted once the next one has been written, the last ones when the driver ends.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import language, line_dedup, mixing, near_dedup, packing
from eventlens.llm._shared import delete, new_folder, table

#: Percent of common shingles from which documents are near duplicates here; 85 is the contract of op9_near_dedup alone.
NEAR_PERCENT = 80
#: The vocabulary that the last stage tokenises with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, made that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is clear. Learned from all that have a language."""
    return language.keep_identified(docs, language.learn(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines deleted; documents with nothing left go."""
    return _with_length(line_dedup.keep_text(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id."""
    return near_dedup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder, before = new_folder(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        delete(spark, *before)
        before = [f"{folder}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
