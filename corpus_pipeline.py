"""A corpus pipeline: each stage applies one operator to all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and whatever other columns docs has, by whatever names: rows travel whole. An empty
table passes through all stages. What each does with nulls and repeated rows is said with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.llm import grace_dedup, language_id, mixing, near_dup, packing
from oddsmill.llm.common import documents, scratch_path
from oddsmill.llm.queries import id_fold


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which a language is given stay; null, empty and letterless texts go.

    Every row is judged by its own text, so repeated rows and null ids stay or go like others. Null languages teach nothing; if
    there is nothing to learn from, no language is known and all rows go.
    """
    model = language_id.learn(docs, ~F.coalesce(id_fold(3) == 1, F.lit(False)))
    return language_id.known_only(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text the one with the largest id stays; null counts as the empty text.

    A null id is smaller than all others; of rows that repeat id and text, one stays.
    """
    return grace_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, directly or through others, the one with the least id stays.

    Null, empty and wordless texts are like nothing else and stay, as do rows of null id; of rows that repeat id and text, one stays.
    """
    return near_dup.one_of_each_group(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says, in training order.

    A null source is a source of its own; null, empty and wordless texts are never read; repeated rows count each, null ids like others.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by training window: each token id of each row in one piece.

    A null or empty text is its end id alone; repeated rows and null ids are packed each. Returns the columns of pieces.
    """
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Tokenising and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
