"""The corpus pipeline: quality filter, language filter, near-duplicate removal, source mixing and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import langid, mixing, packing, quality, simhash
from recallforge.llm.common import cut, free_name, scratch, table

#: A text is rejected if it is in no language with at least this probability: the second bar is for texts of fewer than SHORT bytes, which say less.
NO_LANGUAGE, SURELY_NONE, SHORT = 0.5, 0.98, 256
#: And one of SHORT bytes or more if no language has this share of it.
SHARE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more; a null or empty text has the score of the bias. Without a label all stay."""
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "_quality")
    return quality.classify(docs, weights, score).where(F.col(score) >= 0.5).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected are null texts and those without a letter, those whose letters are no language, and long ones of mixed languages.

    Short texts, which say little, are rejected only if they are surely none. Without a language to learn every document is rejected.
    """
    lang, score, none = (free_name(docs, n) for n in ("_lang", "_score", "_none"))
    named = langid.label(docs, langid.fit(docs), lang, score, none)
    short = F.octet_length("text") < SHORT
    known = F.when(short, F.col(none) < SURELY_NONE).otherwise((F.col(none) < NO_LANGUAGE) & (F.col(score) >= SHARE * (1 - F.col(none))))
    return named.where((F.col(lang) != langid.UND) & known).drop(lang, score, none)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id; a null one only if the group has no other."""
    row = free_name(docs, "_row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = simhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    first = groups.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)["row"].alias(row))
    return numbered.join(first.select(row), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without words, null texts among them, are never taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 1024 tokens; a null text is the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_language),
    ("simhash near-dedup", keep_one_of_each),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models, a hash sample and a tokenizer are not SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
