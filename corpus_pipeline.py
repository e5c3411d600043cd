"""The corpus pipeline: five operators in turn, each stage written as Parquet and read again by the next.

Every stage takes rows of null or repeated doc_ids as documents of their own, gives an empty table for an empty one, and
all but the last return the columns of docs, whatever others there are; a text is read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import lean, new_folder
from plumbline.llm.language_id import UND, fit_language_id, identify
from plumbline.llm.mixing import REST, WEIGHTS, mix_sources
from plumbline.llm.near import near_dedup
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import redact_pii
from plumbline.llm.token_counts import tokenizer_path

#: Least score of a language; a document below it, or of no language, is rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; a null lang becomes the one told. Null texts, texts without a letter and
    those of a score below LEAST_SCORE go. Without any labelled text no language is known, and all go."""
    lean(spark)
    found = identify(docs, fit_language_id(docs), lang="__pred", score="__score")
    kept = found.where((F.col("__pred") != UND) & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__pred")).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: similarity 0.8 or more of five-word shingles, verified. It is
    that of the smallest doc_id, a null one only if there is no other; texts without words, null ones too, are copies."""
    lean(spark)
    return near_dedup(docs, shingle=5, least=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data and secrets replaced by marks; n_chars follows. A null text stays null."""
    lean(spark)
    return redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's weights ask for, in global random order. Null texts weigh nothing but are drawn
    like others of their source; rows of one doc_id are drawn alike; a source without any text gives none."""
    return mix_sources(docs, WEIGHTS, REST).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids: a row for each piece of a document, with its ids. A null or empty text is its end mark alone;
    copies that the mixture drew have pieces each."""
    lean(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language ID", language_stage), ("SimHash near-dedup", dedup_stage), ("PII", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL can't express the network, the trees or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = new_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
