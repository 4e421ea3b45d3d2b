"""The document pipeline: five stages of the llm operators, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.

Edge cases: rows with null, empty or short texts fail the quality rules and go;
a null language has a reference of its own; of equal rows, and of equal texts,
the second stage keeps one, with a null id only where all have none; texts are
whole in every stage, however long; a null source is a source; an empty table
gives an empty result of every stage; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rmalytics.llm.jaccard_join import one_of_each
from rmalytics.llm.piece_tokens import piece_tokens
from rmalytics.llm.pseudonyms import pseudonyms
from rmalytics.llm.quality_rules import quality_rules
from rmalytics.llm.registry import PIECES, PSEUDONYM_KEY, tokenizer_path
from rmalytics.llm.source_mixing import mix_sources
from rmalytics.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return one_of_each(spark, docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; ``n_chars`` follows where a text has changed."""
    out = pseudonyms(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.when(F.col("n_pseudonyms") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    out = mix_sources(spark, docs, F.array("source")).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's pieces."""
    return piece_tokens(docs, tokenizer_path(PIECES))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixing),
    ("SentencePiece", tokens),
]

#: SQL can't express the pseudonyms, the seeded selection and the tokenizer;
#: tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
