"""A corpus through five stages: language, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns of ``documents``. Their results are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import langid, mixing, sentencepiece, simhash, substrings
from tallyweave.llm.common import shared_dir, table
from tallyweave.llm.queries import MIX_MOST, MIX_WEIGHTS


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or unlike any known language go."""
    return langid.fluent(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has; emptied documents go."""
    return counted(substrings.without_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return counted(mixing.mixed(docs, MIX_WEIGHTS, MIX_MOST))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document."""
    return sentencepiece.encoded(docs, sentencepiece.public_model())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't express these stages; tests compare their operators with plain versions: counts, all pairs, all windows, the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
