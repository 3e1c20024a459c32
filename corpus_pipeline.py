"""A corpus from raw documents to token ids, in five stages.

Language identification drops texts in no known language, line deduplication
cuts lines that came before, near-deduplication leaves one document of each
group, mixing takes documents by the weights of their sources (one may be taken
twice), and byte-level BPE turns the texts into ids. Every stage works on all
that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, columns, language_id, line_dedup, mixing, near_dedup, queries
from driftline.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that labelled documents show; texts without letters go."""
    docs = columns.pick(docs, *COLUMNS)
    labelled = docs.filter(~queries.held_out(F.col("doc_id")))
    return language_id.keep_known(docs, language_id.learn(labelled))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line where it comes first; documents of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs, others=("lang", "source", "n_chars"))
    emptied = (F.col("n_removed") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.filter(~emptied).select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.take_mix(docs, queries.SOURCE_WEIGHTS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    n_tokens = F.size("ids").cast("bigint")
    return found.select("doc_id", n_tokens.alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]
#: Language models, tokens and near copies have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next one reads it."""
    docs = columns.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
