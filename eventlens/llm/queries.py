"""Queries over the corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import ann, fingerprint, language, licenses, line_dedup, mixing, near_dedup, packing, quality, url_reputation
from eventlens.llm._shared import held_out, table
from eventlens.llm.oracles import ORACLES  # noqa: F401


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced_mix(table(spark, sf_dir, "documents")).drop("mark")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs.where(~held_out())))


#: Words of a host's name that mark its pages as spam.
SPAM_WORDS = ("ads", "adult", "bets", "betting", "casino", "escort", "loans", "payday", "pharmacy", "pills", "poker", "porn", "slots", "tracker", "viagra", "xxx")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, bad`` of every page; bad is null where nothing is known.

    The pages of the test tables are renderings of documents, whose number ends the path
    of their url. A page counts as bad if its document is labelled of low quality, or if
    a part of its host's name between dots and hyphens is one of ``SPAM_WORDS``.
    """
    number = F.regexp_extract("url", r"://[^/?#]*/[^?#]*?(\d{1,18})[^0-9?#]*(?:[?#]|$)", 1)
    spam = url_reputation.host_of().rlike(rf"(^|[.-])({'|'.join(SPAM_WORDS)})([.:-]|$)")
    pages = table(spark, sf_dir, "pages").select("url", F.when(number != "", number).cast("long").alias("doc_id"), spam.alias("spam"))
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    bad = labels.groupBy("doc_id").agg((1 - F.max("quality")).cast("int").alias("bad"))
    return pages.join(bad, "doc_id", "left").select("url", F.when(F.col("spam"), 1).otherwise(F.col("bad")).alias("bad"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_deleted")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ann, op2_mix, op3_fingerprint, op4_language, op5_url_reputation,
        op6_line_dedup, op7_licenses, op8_quality, op9_near_dedup, op10_packing,
    )
}

